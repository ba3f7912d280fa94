import random
import re

from pyspark.sql import functions as F

from chronoweft.llm import pii as M

# The plain expressions that the fast ones must equal.
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for kind, rx in PLAIN:
        for m in re.finditer(rx, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] * ok
    return ",".join(out)


def test_base_spans_are_the_plain_expressions(spark):
    rnd = random.Random(2)
    bits = ["a@b.c", "_d@e.f", "@", ".", "1.2.3.4", "256.", "0001.", " ", "-", "+1 (743) 555-3824", "4111-1111 1111 1111", "4465758382889437", "é", "😀", "+", "12", "999999999", "x", "\n", "("]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "x" * 4000 + "@y.z " + "9" * 5000 + " +1" + "(" * 400 + "23456789"), (None, "a@b.c"), (7, "1.2.3.4"), (7, "1.2.3.4")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")
    got = sorted((repr(r.doc_id), r.s) for r in M.find(df).select("doc_id", M.spans_text(F.col("base")).alias("s")).collect())
    assert got == sorted((repr(i), base(t)) for i, t in rows)
    assert M.find(df.limit(0)).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"So please ring me at +1 (555) 010-{1000 + i} before noon. Then rest.") for i in range(8)]
    rows += [(20, "So please ring me at 5550107788 before noon. Then rest."), (21, "The year was 20241 before noon."), (22, "In total 5550107788 bolts were counted there.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.s for r in M.find(df).select("doc_id", M.spans_text(F.col("added")).alias("s")).collect()}
    assert found[20] == "phone:21:31" and not any(v for k, v in found.items() if k != 20)


def test_discovery_on_planted_slots(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 7)))
    rows, planted, i = [], {}, 0
    for i in range(600):
        left, right = " ".join(word() for _ in range(4)), " ".join(word() for _ in range(4))
        number = "".join(rnd.choice("0123456789") for _ in range(10))
        kind = i % 5
        if kind == 0:  # known to the expressions
            rows.append((i, f"{left} reach me on +1 {number[:3]} {number[3:6]}-{number[6:]} {right}"))
        elif kind == 1:  # the same slot, unseen form
            rows.append((i, f"{left} reach me on {number} {right}"))
            planted[i] = rows[-1][1].index(number)
        elif kind == 2:
            rows.append((i, f"{left} mail to {word()}{i}@mail.example.com {right}"))
        elif kind == 3:
            rows.append((i, f"{left} mail to {word()}.{i}7@intranet {right}"))
            planted[i] = rows[-1][1].index(" to ") + 4
        else:  # numbers of other slots
            rows.append((i, f"{left} a total of {number} {right}"))
    # half of the phones' slot is unseen, so the shape or a second word must carry them
    rows += [(1000 + k, f"{word()} reach me on +1 555 010-{1000 + k} {word()}") for k in range(600)]
    rows += [(2000 + k, f"{word()} mail to {word()}{k}@mail.example.com {word()}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s["kind_no"], s["start"]) for s in r.added] for r in M.find(df).select("doc_id", "added").collect() if r.added}
    right = sum(planted.get(k) == v[0][1] and M.KINDS[v[0][0]] == ("phone" if k % 5 == 1 else "email") for k, v in got.items())
    assert right / len(got) >= 0.95 and right / len(planted) >= 0.9


def test_nothing_is_cut(spark):
    long = "9" * 300
    rows = [(i, f"the key id no{i:04d}{long}@x.yz of it") for i in range(12)] + [(90, f"the key id 7{long}@inner of it"), (91, "看" * 400 + " 12345 " + "看" * 400)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "doc_id long, text string, id string, key string, h string, spans string")
    got = {r.doc_id: r.added for r in M.find(df).collect()}
    assert [(s["start"], s["end"]) for s in got[90]] == [(11, 11 + 307)] and got[91] == []
    out = M.redact(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()}[90] == "the key id <email> of it"
    assert M.redact(df.limit(0)).count() == 0


def test_redaction(spark):
    rows = [(1, "mail é a@b.c, or 10.0.0.1!"), (2, None), (3, "clean"), (None, "call +1 (743) 555-3824"), (1, "other a@b.c")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string")
    out = M.redact(df)
    assert out.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, [(1, "mail é <email>, or <ip>!"), (2, None), (3, "clean"), (None, "call <phone>"), (1, "other <email>")]))

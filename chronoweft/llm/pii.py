"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

One pass over the texts finds the base entities (e-mail, IP, card, phone) and
the other identifier-like tokens, each with the words around it.  From there on
only these few rows travel.  The base entities are seeds of a bipartite graph of
lexical patterns (the words around an entity) and instances (the entities'
texts): patterns are scored by the share of their instances that are known to
be of a kind, instances by the patterns that they appear in, in turn and until
no pattern is new.  Patterns that end with high confidence mark the identifiers
in their slots that no expression knows.  A pattern is one or two words to the
left, one to the right, or one on either side, and each of the one-word ones
again together with the shape of what it surrounds (digits masked).

Out of reach: identifiers without a digit or an ``@``, and those whose contexts
are no more frequent with identifiers than without.

Positions come from lengths: ``split`` gives what lies between the matches that
``regexp_extract_all`` gives, and a running sum over both counts code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_all, holding, release, staged

KINDS = ("email", "ip", "card", "phone")
_CANDIDATE = "token"
#: The base expressions, written so that matching is linear.  A
#: match may start only where the text before it cannot lengthen it, or where
#: the last match ended (\G), which is where the plain expression would start.
_LOCAL = "[A-Za-z0-9._%+-]"
#: What candidates are made of: cut at white space and punctuation, then joined
#: with the groups of digits that follow after single spaces.
_WORD, _LETTER = r"[\p{L}\p{N}@._%+-]", r"[\p{L}._%+-]"
_EXPRESSIONS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    _CANDIDATE: rf"(?<!{_WORD}){_LETTER}*+[0-9@]{_WORD}*+(?:\x20[0-9][0-9-]*+(?!{_WORD}))*+",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP_VALID = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_CORE = r"[\p{L}\p{N}+](?:.*[\p{L}\p{N}])?"
#: Pieces between spaces that are looked at for context words on either side.
_CONTEXT = 4
#: What a text must have to be found as a kind.
_SIGNS = {"email": "@", "ip": r"[0-9A-Fa-f]*[.:][0-9A-Fa-f]*[.:]", "card": r"(?:[0-9][^0-9]*){8}", "phone": r"(?:[0-9][^0-9]*){6}"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _has(text: Column, kind: str) -> Column:
    """A cheap test that must hold for ``kind`` to match at all."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]" if kind != _CANDIDATE else "[0-9@]")


def _valid(v: Column, kind: str) -> Column:
    """Whether a whole match counts."""
    if kind == "ip":
        return v.rlike(_IP_VALID)
    if kind == "card":
        d = _digits(v)
        fits = F.length(d).between(13, 19)
        return fits & F.call_function("luhn_check", F.when(fits, d).otherwise("1"))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _row(kind: str):
    """From (value, gap, next gap) and a number to (kind, i, gap, size, valid, value, left, right)."""
    blank = lambda c: F.translate(c, "\t\n\x0b\x0c\r\u00a0", " " * 6)

    def row(m: Column, i: Column) -> Column:
        v, gap = m["v"], m["g"]
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(gap).alias("gap"),
            F.length(v).alias("size"),
            _valid(v, kind).alias("valid"),
            v.alias("value"),
            F.substring_index(blank(gap), " ", -_CONTEXT).alias("left"),
            F.substring_index(blank(m["n"]), " ", _CONTEXT).alias("right"),
        )

    return row


def entities(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``rid`` (unique), ``id``, ``h`` (hash of the text), ``found`` (array of matches)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(id).alias("id"), t.alias("t"))
    # The texts between the matches are a column of their own, or each match would split the text anew.
    gaps = {k: F.when(_has(F.col("t"), k), F.split("t", rx, -1)).alias(f"g_{k}") for k, rx in _EXPRESSIONS.items()}
    cut = base.select("id", "t", *gaps.values())
    parts = []
    for kind, rx in _EXPRESSIONS.items():
        g = F.col(f"g_{kind}")
        n = F.size(g) - 1
        v = F.regexp_extract_all("t", F.lit(rx), F.lit(0))
        zipped = F.arrays_zip(v.alias("v"), F.slice(g, F.lit(1), n).alias("g"), F.slice(g, F.lit(2), n).alias("n"))
        none = F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,valid:boolean,value:string,left:string,right:string>>")
        parts.append(F.when(n > 0, F.transform(zipped, _row(kind))).otherwise(none))
    made = cut.select(F.monotonically_increasing_id().alias("rid"), "id", F.xxhash64("t").alias("h"), F.concat(*parts).alias("found"))
    return staged(made, "entities")


def positions(found: DataFrame) -> DataFrame:
    """Rows (rid, kind, start, end, value, left, right), code points, of valid base entities and of candidates clear of them."""
    rows = found.select("rid", F.explode("found").alias("m")).select("rid", "m.*")
    w = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(w)).withColumn("start", F.col("end") - F.col("size"))
    v, d = F.col("value"), F.length(_digits(F.col("value")))
    base = rows.where((F.col("kind") != _CANDIDATE) & F.col("valid"))
    core, lead = F.regexp_extract(v, _CORE, 0), F.length(F.regexp_extract(v, r"^[^\p{L}\p{N}+]*", 0))
    cand = (
        rows.where(F.col("kind") == _CANDIDATE)
        .withColumn("start", F.col("start") + lead)
        .withColumn("value", core)
        .withColumn("end", F.col("start") + F.length("value"))
        .where((F.length("value") >= 5) & ((d >= 4) | F.contains(v, F.lit("@"))))
    )
    both = base.unionByName(cand).select("rid", "kind", "start", "end", "value", "left", "right")
    is_base = F.col("kind") != _CANDIDATE
    up = Window.partitionBy("rid").orderBy("start", F.col("end")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("rid").orderBy(F.col("start").desc(), F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    clear = both.withColumn("before", F.max(F.when(is_base, F.col("end"))).over(up)).withColumn("after", F.min(F.when(is_base, F.col("start"))).over(down))
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return clear.where(is_base | free).drop("before", "after")


def _patterns() -> Column:
    """The lexical patterns of an entity, ``_`` being its place: words around it, alone and with its shape."""

    def words(c: str) -> Column:
        return F.filter(F.split(F.lower(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")

    left, right = words("left"), words("right")
    one, two = F.get(left, F.size(left) - 1), F.coalesce(F.get(left, F.size(left) - 2), F.lit("^"))
    one, nxt = F.coalesce(one, F.lit("^")), F.coalesce(F.get(right, F.lit(0)), F.lit("$"))
    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), r"\p{L}+", "a")
    text = lambda *parts: F.concat_ws(" ", *parts)
    plain = [text(two, one, F.lit("_")), text(one, F.lit("_"), nxt), text(one, F.lit("_")), text(F.lit("_"), nxt)]
    return F.array(*plain, text(F.lit("="), one, shape), text(F.lit("="), shape, nxt))


def discover(entity_rows: DataFrame, min_confidence: float = 0.8, min_support: int = 3, smoothing: float = 1.0) -> DataFrame:
    """Candidates of ``positions`` that confident patterns mark: (rid, kind, start, end, score).

    Pattern and instance scores alternate until no pattern is new (known
    instances only gain, so the confident patterns only grow in number).  A
    pattern counts from ``min_support`` distinct known instances of a kind, and if
    their scores make up ``min_confidence`` of all its distinct instances and
    ``smoothing`` more.  A candidate is found as a kind only if it has its signs:
    an ``@``, two dots or colons, eight digits, six digits.
    """
    inst = F.xxhash64(F.lower("value"))
    occ = staged(entity_rows.select("rid", "kind", "start", "end", "value", inst.alias("instance"), F.explode(_patterns()).alias("pattern")), "occurrences")
    edges = staged(occ.select("pattern", "instance").distinct(), "edges")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = staged(occ.where(F.col("kind") != _CANDIDATE).select("instance", "kind").distinct().withColumn("score", F.lit(1.0)), "seeds")
    known = seeds.select("instance").distinct()
    scores, sure, confident = seeds, None, 0
    while True:
        hits = edges.join(scores, "instance").groupBy("pattern", "kind")
        hits = hits.agg(F.sum("score").alias("hit"), F.count_if(F.col("score") >= min_confidence).alias("support"))
        judged = hits.where(F.col("support") >= min_support).join(totals, "pattern").withColumn("confidence", F.col("hit") / (F.col("total") + smoothing))
        now = staged(judged.where(F.col("confidence") >= min_confidence).select("pattern", "kind", "confidence"), "patterns")
        if sure is not None:
            release(sure)
        sure, before, confident = now, confident, now.count()
        if confident == before:
            break
        miss = F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))))
        grown = edges.join(sure, "pattern").groupBy("instance", "kind").agg((1 - F.exp(miss)).alias("score"))
        scores = seeds.unionByName(grown.join(known, "instance", "left_anti"))
    fits = F.lit(False)
    for kind, signs in _SIGNS.items():
        fits = fits | ((F.col("as_kind") == kind) & F.col("value").rlike(signs))
    found = (
        occ.where(F.col("kind") == _CANDIDATE)
        .join(sure.withColumnRenamed("kind", "as_kind"), "pattern")
        .where(fits)
        .groupBy("rid", "start", "end")
        .agg(F.max(F.struct("confidence", "as_kind")).alias("b"))
        .select("rid", F.col("b.as_kind").alias("kind"), "start", "end", F.col("b.confidence").alias("score"))
    )
    out = staged(found, "discovered")
    release(occ, edges, seeds, sure)
    return out


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``h``, ``base`` and ``added``, arrays of (kind_no, start, end).

    ``base`` are the valid matches of the base expressions, ``added`` what the
    patterns found, never overlapping a base span; both are in order of kind and
    start, in code points, end exclusive.  Null texts are empty; empty texts and
    tables give empty arrays and tables; repeated rows and ids stay; other
    columns are not read.  ``h`` is ``xxhash64`` of the text.
    """
    found = entities(docs, id, text)
    rows = staged(positions(found), "positions")
    number = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    as_span = F.struct(number[F.col("kind")].alias("kind_no"), "start", "end")
    base = rows.where(F.col("kind") != _CANDIDATE).select("rid", as_span.alias("s"), F.lit(True).alias("is_base"))
    more = discover(rows, **how)
    added = more.select("rid", as_span.alias("s"), F.lit(False).alias("is_base"))
    spans = (
        base.unionByName(added)
        .groupBy("rid")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("is_base"), F.col("s")))).alias("base"),
            F.array_sort(F.collect_list(F.when(~F.col("is_base"), F.col("s")))).alias("added"),
        )
    )
    none = F.array().cast("array<struct<kind_no:int,start:bigint,end:bigint>>")
    out = found.select("rid", "id", "h").join(spans, "rid", "left")
    out = out.select(F.col("id").alias(id), "h", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))
    return holding(out, found, rows, more)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind_no"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets.

    Spans that overlap become one mark, named after the first.  Rows without
    spans, and null texts, stay as they are.
    """
    found = find(docs, id, text, **how)
    own, key, h, cut = fresh_all(docs.columns, "id", "key", "h", "spans")
    spans = found.where((F.size("base") > 0) | (F.size("added") > 0))
    spans = spans.select(F.col(id).alias(own), F.col("h").alias(key), F.concat("base", "added").alias(cut)).distinct()
    by_place = F.array_sort(F.transform(cut, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind_no"].alias("kind_no"))))
    state = "struct<at:bigint,parts:array<string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts")).cast(state)
    name = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    t = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh_mark = s["start"] >= acc["at"]
        parts = F.when(fresh_mark, F.concat(acc["parts"], F.array(piece, F.get(name, s["kind_no"])))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts")).cast(state)

    done = F.aggregate(by_place, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))))
    joined = docs.withColumn(h, F.xxhash64(F.coalesce(t.cast("string"), F.lit(""))))
    joined = joined.join(spans, F.col(id).eqNullSafe(F.col(own)) & (F.col(h) == F.col(key)), "left")
    return holding(joined.withColumn(text, F.when(F.col(cut).isNotNull(), done).otherwise(t)).select(*docs.columns), found)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_added."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = find(docs)
    every = F.array_sort(F.concat("base", "added"))
    counts = [F.size(F.filter("base", lambda s, i=i: s["kind_no"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    out = r.select(
        "doc_id",
        *counts,
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
    return holding(out, r)

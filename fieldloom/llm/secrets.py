"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidate spans come from three patterns; each has a value (what follows the assignment sign, or the whole match).
Only hashes of values are kept, without full stops at the end. For each hash the corpus counts its distinct owners and
repositories, wherever the value stands, by a pattern or bare: a value that several owners hold, or that one owner has
in many repositories, is a copied example (``shared``), one that a single owner holds and that looks random is a live
credential (``live``), any other is ``weak``. Live values also count where no pattern reaches them: a bare token, or
what it has behind its last ``=`` or ``/``, whose hash is that of a live value is one more span, of kind ``live``.

Positions are code points: the pieces between the matches, as split() gives them, and the matches are measured and
added up. Each pattern first passes a cheap gate, so that most texts are read by the gates alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import spare, stored, text_of

#: fixed values of the contract, in its order: kind, pattern, group of the value, least length of the value
KINDS = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: whether a text can hold a match of the kind that is long enough
GATES = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
#: a bare token: long, with letters and digits
BARE, BARE_LENGTH = r"[A-Za-z0-9+/_.=-]{16,}", 16
BARE_GATE = BARE
#: values that stand for a secret in documentation
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your_?|x{4}|1234|abcdef|(.)\1{5}"

SPANS = "array<struct<start:int,kind:int,end:int,hash:string,random:boolean>>"
LIVE = len(KINDS)


def _random_looking(value: Column) -> Column:
    """Long, of letters and digits, of at least eight different characters, and no known stand-in."""
    return (
        (F.length(value) >= BARE_LENGTH)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
        & ~value.rlike(PLACEHOLDER)
    )


def _spans(text: Column, pattern: str, gate: str, group: int, found) -> Column:
    """What ``found(begin, end, value)`` gives as an array of spans for each of the pattern's leftmost non-overlapping matches, in order."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    each = F.zip_with(F.zip_with(hits, values, lambda h, v: F.struct(h.alias("hit"), v.alias("value"))), F.slice(pieces, F.lit(1), F.size(hits)), lambda x, p: F.struct(x["hit"].alias("hit"), x["value"].alias("value"), F.length(p).alias("before")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["before"]
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], found(begin, end, x["value"])).alias("out"))

    return F.when(text.rlike(gate), F.aggregate(each, start, add, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))


def _span(begin: Column, kind: int, end: Column, value: Column) -> Column:
    """One span; its value counts without full stops at the end."""
    value = F.rtrim(value, F.lit("."))
    return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(value, 256).alias("hash"), _random_looking(value).alias("random"))


def base_spans(text: Column) -> Column:
    """All spans of the three kinds, by start and then kind."""

    def long_enough(kind: int, least: int):
        return lambda begin, end, value: F.when(F.length(value) >= least, F.array(_span(begin, kind, end, value))).otherwise(F.array().cast(SPANS))

    return F.sort_array(F.concat(*[_spans(text, p, GATES[k], g, long_enough(i, n)) for i, (k, p, g, n) in enumerate(KINDS)]))


def bare_spans(text: Column, base: Column) -> Column:
    """Bare random-looking tokens that touch no base span: runs without full stops at their end, and what such a run has
    behind its last ``=`` or ``/``."""

    def forms(begin: Column, end: Column, value: Column) -> Column:
        whole = F.rtrim(value, F.lit("."))
        stop = begin + F.length(whole)
        tails = [F.substring_index(whole, mark, -1) for mark in "=/"]
        spans = F.array_distinct(F.array(*[_span(stop - F.length(v), LIVE, stop, v) for v in (whole, *tails)]))
        return F.filter(spans, lambda s: s["random"])

    found = _spans(text, BARE, BARE_GATE, 0, forms)
    return F.filter(found, lambda b: ~F.exists(base, lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"])))


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 2) -> DataFrame:
    """Spans of every row of ``docs`` (doc_id, text, the owner and repository columns).

    Returns doc_id, text_hash, spans (array of start, kind, end, verdict), in a row for each row of ``docs``. kind is
    the place in ``KINDS``, or ``LIVE`` for a bare occurrence of a live value; verdict is live, shared (more than
    ``max_owners`` owners or ``max_repositories`` repositories) or weak. A value that no pattern finds anywhere has no
    verdict and no span. A null text is empty, and has no spans; a text of any length is read whole, by one task. Null
    owners count as one owner. Repeated rows each get their spans; equal texts get equal spans. Other columns play no
    part. An empty table gives none.
    """
    text = text_of("text")
    found = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("repository"))
    found = found.withColumn("base", base_spans(F.col("text"))).withColumn("bare", bare_spans(F.col("text"), F.col("base")))
    found = stored(found.drop("text"), "secret-spans")

    # one row a value, owner and repository, wherever the value stands; then counts a value: both are summed before they
    # are shuffled, and a value that many texts hold is a few rows
    seen = found.select(F.explode(F.concat("base", "bare")).alias("s"), "owner", "repository").select("s.hash", "s.random", (F.col("s.kind") < LIVE).alias("told"), "owner", "repository")
    candidates = seen.groupBy("hash", "owner", "repository").agg(F.bool_or("random").alias("random"), F.bool_or("told").alias("told"))
    per_owner = candidates.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.bool_or("random").alias("random"), F.bool_or("told").alias("told"))
    values = per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.bool_or("random").alias("random"), F.bool_or("told").alias("told")).where("told")
    copied = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    verdicts = values.select("hash", F.when(copied, "shared").when(F.col("random"), "live").otherwise("weak").alias("verdict"))

    # equal texts of one document are looked up once
    touched = found.where((F.size("base") > 0) | (F.size("bare") > 0)).select("doc_id", "text_hash", "base", "bare").dropDuplicates(["doc_id", "text_hash"])
    exploded = touched.select("doc_id", "text_hash", F.explode(F.concat("base", "bare")).alias("s")).select("doc_id", "text_hash", "s.start", "s.kind", "s.end", "s.hash")
    judged = exploded.join(verdicts, "hash", "left").where((F.col("kind") < LIVE) | (F.col("verdict") == "live"))
    spans = judged.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("spans"))
    left, right = found.select("doc_id", "text_hash").alias("l"), spans.alias("r")
    joined = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")), "left")
    return joined.select("l.doc_id", "l.text_hash", F.coalesce("r.spans", F.array().cast("array<struct<start:int,kind:int,end:int,verdict:string>>")).alias("spans"))


def redact(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every span replaced by its kind and verdict, and n_chars set anew where the table has it.

    All rows and columns stay. Spans that overlap are one gap, named by the first of them.
    """
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("live"))
    spans = scan(docs, **how).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"]).alias("s")
    (hashed,) = spare(docs, "text_hash")
    rows = docs.withColumn(hashed, F.xxhash64(text_of("text"))).alias("d")
    joined = rows.join(spans, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.{hashed}") == F.col("s.text_hash")), "left")
    text = F.col("d.text")

    def add(acc: Column, s: Column) -> Column:
        gap = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit(" "), s["verdict"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("s.spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.col("s.spans").isNull(), text).otherwise(done)
    columns = {c: F.col(f"d.{c}") for c in docs.columns} | {"text": clean}
    out = joined.select(*[v.alias(k) for k, v in columns.items()], F.col("s.spans").isNotNull().alias(hashed))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(hashed), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(hashed)

"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Seed entities are the matches of four fixed patterns and tokens that look random
(long, letters and digits in turn). Seeds and all other identifier-shaped tokens
are instances. What stands around an instance gives the lexical patterns that
extract it: the word before it, the field name that touches it, the kind of
assignment or quotes around it, its leading letters, its class of letters and
length. Patterns are scored by the share of their instances that are believed,
instances by the patterns that extract them, and so on for a few rounds; tokens
that confident patterns extract become spans of kind ``id``, and so do seed
tokens, but only where such a pattern extracts them. Only DataFrame functions run
here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stash

#: Fixed values, in the order that breaks ties. An email begins where a run of its letters or the last match ends, and
#: an address where a run of digits begins, which finds the same matches as trying every place of the run.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-shaped: a run of letters, digits, - and _ that has a digit and six characters or more.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
NEEDS = {"email": "@", "ip": "[0-9]\\.", "card": "[0-9]", "phone": "\\+[0-9]", "id": "[0-9]"}
FOUND = "id"
#: A token looks random from this many characters and changes between letters and digits on.
RANDOM_LENGTH = 20
RANDOM_CHANGES = 8
#: Spans up to this many bytes go to all texts; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
ORDER = [*KINDS, FOUND]
ROUNDS = 3
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.5
ACCEPT = 0.8


def _hits(kind: str) -> Column:
    """Matches of a kind with the text before each, from what split and extract see of the same matches.

    Both arrays are columns: an expression in a lambda is worked out again for every element.
    """
    gaps, hits = F.col(f"_gaps_{kind}"), F.col(f"_hits_{kind}")
    return F.transform(
        hits,
        lambda h, i: F.struct(
            F.lit(ORDER.index(kind)).alias("kind"),
            i.alias("pos"),
            F.length(F.get(gaps, i)).alias("gap"),
            h.alias("hit"),
            F.substring(F.get(gaps, i), -48, 48).alias("left"),
            F.substring(F.get(gaps, i + 1), 1, 4).alias("right"),
        ),
    )


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    parts = F.split(hit, r"\.")
    small = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(parts, lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).cast("int"), F.lit(999)) <= 255)
    is_ = lambda name: kind == ORDER.index(name)
    return (
        F.when(is_("ip"), small)
        .when(is_("card"), F.length(digits).between(12, 19) & _luhn(digits))
        .when(is_("phone"), F.length(digits).between(9, 15))
        .otherwise(F.lit(True))
    )


def instances(docs: DataFrame) -> DataFrame:
    """All valid base matches and all other identifier-shaped tokens of ``docs``, with one empty row for texts without any.

    Columns: _row, doc_id, text_hash, kind (number in ORDER, null for none),
    start, end (code points, end exclusive), hit, left and right (up to 48
    characters before and 4 after it). Tokens that overlap a base match are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<kind:int,pos:int,gap:int,hit:string,left:string,right:string>>")
    patterns = {**KINDS, FOUND: CANDIDATE}
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"))
    needed = {k: F.col("text").rlike(NEEDS[k]) for k in patterns}
    cut = numbered.withColumns(
        {f"_gaps_{k}": F.when(needed[k], F.split("text", p, -1)) for k, p in patterns.items()}
        | {f"_hits_{k}": F.when(needed[k], F.regexp_extract_all("text", F.lit(p), 0)) for k, p in patterns.items()}
    )
    found = F.concat(*[F.coalesce(_hits(k), none) for k in patterns])
    rows = cut.select("_row", "doc_id", "text_hash", F.explode_outer(found).alias("x")).select("_row", "doc_id", "text_hash", "x.*")
    before = Window.partitionBy("_row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(before)).withColumn("start", F.col("end") - F.length("hit"))
    valid = placed.filter(F.col("kind").isNull() | _valid(F.col("kind"), F.col("hit")) | (F.col("pos") == 0)).withColumn("ok", F.col("kind").isNotNull() & _valid(F.col("kind"), F.col("hit")))
    base = F.col("ok") & (F.col("kind") < ORDER.index(FOUND))
    along = Window.partitionBy("_row").orderBy("start", "kind", "end")
    reach = F.max(F.when(base, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    # the same rows from the other end: a frame that shrinks would be worked out anew for each row
    backwards = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
    ahead = F.min(F.when(base, F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    clear = valid.withColumns({"_reach": reach, "_ahead": ahead})
    overlaps = (F.col("kind") == ORDER.index(FOUND)) & (F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_ahead") < F.col("end"), F.lit(False)))
    # a first row that is not valid stays as an empty row, so that no text is lost
    keep = F.col("ok") & ~F.coalesce(overlaps, F.lit(False))
    return clear.select("_row", "doc_id", "text_hash", *[F.when(keep, F.col(c)).alias(c) for c in ("kind", "start", "end", "hit", "left", "right")])


def looks_random(hit: Column) -> Column:
    """Whether a token is long and its letters and digits take turns often."""
    turns = F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[^A-Za-z0-9]", ""), "[A-Za-z]+", "a"), "[0-9]+", "9")
    return (F.length(hit) >= RANDOM_LENGTH) & (F.length(turns) > RANDOM_CHANGES)


def edges(found: DataFrame) -> DataFrame:
    """The pattern-instance graph: each pattern that extracts each distinct instance, whether that is a base match and whether it is a seed."""
    left = F.lower(F.col("left"))
    token = F.col("kind") == ORDER.index(FOUND)
    touching = F.regexp_extract(left, r"([a-z_]{2,}[\x20]?[=:#][\x20]?[\"']?)$", 1)
    assigned = F.regexp_extract(left, r"[a-z_]{2,}([\x20]?[=:#][\x20]?[\"']?)$", 1)
    word = F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1)
    opened, closed = F.regexp_extract(left, r"([\"'(\[<{])$", 1), F.regexp_extract("right", r"^([\"')\]>}])", 1)
    letters = F.regexp_extract("hit", r"^([A-Z]{3,6})(?=[A-Z0-9]*[0-9])", 1)
    letter_class = F.when(F.col("hit").rlike("^[0-9a-f]+$"), "hex").when(F.col("hit").rlike("^[0-9A-F]+$"), "HEX").when(F.col("hit").rlike("^[0-9a-z]+$"), "lower").when(F.col("hit").rlike("^[0-9A-Z]+$"), "upper").otherwise("mixed")
    patterns = F.array_compact(
        F.array(
            F.when(touching != "", F.concat(F.lit("touch:"), touching)),
            F.when((assigned != "") & token, F.concat(F.lit("assign:"), assigned, F.lit(" then "), closed)),
            F.when((opened != "") & (closed != "") & token, F.concat(F.lit("around:"), opened, closed)),
            F.when(word != "", F.concat(F.lit("word:"), word)),
            F.when(letters != "", F.concat(F.lit("begin:"), letters)),
            F.when(token & looks_random(F.col("hit")), F.concat(F.lit("class:"), letter_class, F.lit(":"), F.length("hit"))),
        )
    )
    return (
        found.filter(F.col("kind").isNotNull())
        .select(F.explode(patterns).alias("pattern"), "hit", ~token, (~token | looks_random(F.col("hit"))).alias("seed"))
        .toDF("pattern", "hit", "base", "seed")
        .groupBy("pattern", "hit")
        .agg(F.max("base").alias("base"), F.max("seed").alias("seed"))
    )


def score_graph(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Score the instances that are no base matches, round by round: ``hit`` and ``score``.

    A pattern's confidence is the mean belief in its distinct instances, and 0
    with fewer than MIN_SUPPORT that are believed. Belief in seeds stays at 1, in
    another token it is its score: one minus the chance that all its confident
    patterns are wrong.
    """
    graph = stash(graph)
    belief = graph.filter("seed").select("hit", F.lit(1.0).alias("score")).distinct()
    for _ in range(rounds):
        believed = graph.join(belief, "hit", "left").withColumn("score", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))))
        confidence = (
            believed.groupBy("pattern")
            .agg(F.avg("score").alias("mean"), F.count_if(F.col("score") >= MIN_CONFIDENCE).alias("support"))
            .filter((F.col("support") >= MIN_SUPPORT) & (F.col("mean") >= MIN_CONFIDENCE))
            .select("pattern", F.least(F.col("mean"), F.lit(0.999)).alias("mean"))
        )
        belief = stash(graph.filter(~F.col("base")).join(confidence, "pattern").groupBy("hit").agg((1 - F.exp(F.sum(F.log1p(-F.col("mean"))))).alias("score")))
    return belief


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash and the sorted array ``spans`` of (start, kind_no, end, kind).

    Null and empty texts have no spans. Repeated rows stay apart. Spans that begin
    together come in the order of kinds. Texts of any length are searched whole.
    Tables without any match give empty arrays, empty tables an empty result;
    other columns of ``docs`` are ignored.
    """
    found = stash(instances(docs))
    accepted = score_graph(edges(found)).filter(F.col("score") >= ACCEPT).select("hit").withColumn("_accepted", F.lit(True))
    new = F.col("kind") == ORDER.index(FOUND)
    # only identifier-shaped tokens, never texts, meet the accepted ones
    judged = found.filter(new).join(accepted, "hit", "left_semi").select("_row", "doc_id", "text_hash", "kind", "start", "end")
    rest = found.select("_row", "doc_id", "text_hash", *[F.when(~F.coalesce(new, F.lit(False)), F.col(c)).alias(c) for c in ("kind", "start", "end")])
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("kind").alias("kind_no"), F.col("end").cast("long").alias("end"))
    named = lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, ORDER)), s["kind_no"] + 1).alias("kind"))
    return (
        rest.unionByName(judged)
        .groupBy("_row", "doc_id", "text_hash")
        .agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"))
        .select("doc_id", "text_hash", F.transform("spans", named).alias("spans"))
    )


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets.

    Null texts stay, and so do all other columns whatever their names. Repeated
    rows are changed alike, and rows of one id each by their own text.
    """
    spans = find(docs.select("doc_id", "text")).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    spans = stash(spans.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "spans"))
    size = spans.agg(F.sum(32 + 48 * F.size("spans"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"), F.xxhash64("text").alias("own_hash"))
    joined = rows.join(spans, F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_hash") == F.col("of_hash")), "left")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.col("own_text")

    def put(a: Column, s: Column) -> Column:
        kept = F.when(s["start"] > a["at"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.array(kept, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))

    cut = F.aggregate("spans", state, put, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, (a["at"] + 1).cast("int"))))
    changed = F.when(F.col("spans").isNotNull(), cut).otherwise(text)
    return joined.select(*[changed.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])

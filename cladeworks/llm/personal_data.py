"""Personal data: fixed patterns give seeds; contexts learned from the seeds find further identifiers.

DataFrame functions only. The scan cuts each text at the matches of each kind, which gives every match with the
length of the gap before it and the words around it; from there on, rows are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeworks.llm.common import table
from cladeworks.session import settle

#: Base kinds in their order, and the forms of their patterns that never go back over what they have read. A match
#: starts where the one before ended or where no character of its first run stands before; ``mark`` must be there.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: What may be an identifier besides: eight or more of these characters in a row, a digit among them.
TOKEN = r"(?<![A-Za-z0-9_@.+/=-])(?=[A-Za-z_@.+/=-]*+[0-9])[A-Za-z0-9_@.+/=-]{7,}+[A-Za-z0-9_/=-]?+"
#: Code points of context on either side.
AROUND = 40
#: Rounds of scoring; a pattern is taken with this share of known instances among this many distinct ones at least;
#: an instance is taken from this score on.
ROUNDS, LEAST_SHARE, LEAST_KNOWN, LEAST_SCORE = 3, 0.6, 5, 0.8
HIT = "struct<kind:string,i:int,gap:int,found:string,left:string,right:string>"


def _hits(kind: str, pattern: str, mark: str) -> Column:
    """The matches of a pattern, in order: gap (code points since the one before), its text, and the text around it."""
    text = F.col("text")
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    cut = F.transform(pieces, lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(AROUND)).alias("left"), F.left(p, F.lit(AROUND)).alias("right")))
    pairs = F.arrays_zip(cut.alias("cut"), F.slice(cut, 2, F.size(cut)).alias("after"), found.alias("found"))
    rows = F.transform(
        F.filter(pairs, lambda x: x["found"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x["cut"]["gap"].alias("gap"), x["found"].alias("found"),
            F.lower(F.regexp_extract(x["cut"]["left"], r"(\S+)\s*$", 1)).alias("left"), F.lower(F.regexp_extract(x["after"]["right"], r"^\s*(\S+)", 1)).alias("right"),
        ),
    )
    digits = F.regexp_instr(text, F.lit("[0-9]")) > 0
    there = digits if not mark else F.contains(text, F.lit(mark)) & (F.lit(True) if mark == "@" else digits)
    none = F.array().cast(f"array<{HIT}>")
    return F.when(there, rows).otherwise(none)


def _luhn(digits: Column) -> Column:
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


def _holds(kind: Column, found: Column) -> Column:
    """Whether a match passes the checks of its kind."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    card = F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(False)


def occurrences(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, kind, start, end, found, left, right, base), and one with a null kind for each document.

    ``row`` tells the rows of ``docs`` apart. Kinds are those of the base, and ``token`` for other possible
    identifiers: those that do not overlap a match of the base that holds. Matches of the base that do not hold are left out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    mark = F.array(F.lit(None)).cast(f"array<{HIT}>")  # so that each document has a row
    hits = F.concat(mark, *(_hits(k, *PATTERNS[k]) for k in KINDS), _hits("token", TOKEN, ""))
    small = settle(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", hits.alias("hits")), "hits")
    rows = small.select("row", "doc_id", F.explode("hits").alias("h")).select("row", "doc_id", "h.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("gap") + F.length("found")).cast("long")).over(upto)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("found")).withColumn("base", F.coalesce(_holds(F.col("kind"), F.col("found")), F.lit(False)))
    rows = rows.where("kind is null or base or kind = 'token'")
    own = Window.partitionBy("row").orderBy("start", F.desc("base"), "end")
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(F.col("base"), F.col("start"))).over(own.rowsBetween(1, Window.unboundedFollowing))
    clear = F.coalesce(ends <= F.col("start"), F.lit(True)) & F.coalesce(starts >= F.col("end"), F.lit(True))
    rows = rows.withColumn("clear", clear).where("kind is null or base or clear")
    return settle(rows.select("row", "doc_id", "kind", "start", "end", "found", "left", "right", "base"), "occurrences")


def bootstrap(rows: DataFrame) -> DataFrame:
    """instance, score: the tokens that contexts of known identifiers lead to.

    Patterns are the word before and the word after an occurrence. In each round a pattern's score is the mean score
    of its occurrences (seeds: 1), an instance's the chance that one of its patterns is right; patterns with enough
    known instances and a high enough score are taken, and what they lead to counts as known in the next round.
    """
    sides = F.explode(F.array(F.concat(F.lit("< "), F.col("left")), F.concat(F.lit("> "), F.col("right")))).alias("pattern")
    seen = rows.where("kind is not null").select(F.lower("found").alias("instance"), "base", sides).where("length(pattern) > 2")
    edges = settle(seen.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("base").alias("seed")), "edges")
    scores = edges.where("seed").groupBy("instance").agg(F.lit(1.0).alias("score"))
    for _ in range(ROUNDS):
        scores = settle(scores, "scores")
        known = edges.join(scores, "instance", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        share = F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 1)
        taken = known.groupBy("pattern").agg(share.alias("share"), F.sum((F.col("score") >= LEAST_SCORE).cast("int")).alias("k"))
        taken = settle(taken.where((F.col("share") >= LEAST_SHARE) & (F.col("k") >= LEAST_KNOWN)).select("pattern", "share"), "patterns")
        led = edges.join(taken, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("share"))))).alias("score"), F.max("seed").alias("seed"))
        seeds = edges.where("seed").groupBy("instance").agg(F.lit(1.0).alias("score"))
        scores = led.where(~F.col("seed")).select("instance", "score").union(seeds)
    seeds = edges.where("seed").select("instance").distinct()
    return scores.where(F.col("score") >= LEAST_SCORE).join(seeds, "instance", "left_anti")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """row, doc_id and spans, array<struct<start, rank, end, kind, found>> in order, of every document.

    Positions are code points, the end exclusive. rank is the kind's place: email, ip, card, phone, then ``id`` for
    what contexts led to. Null and empty texts have no spans; repeated rows are looked at each; other columns are
    ignored; an empty table gives none.
    """
    rows = occurrences(docs)
    found = bootstrap(rows).select("instance", F.lit(True).alias("led"))
    tokens = rows.where("kind = 'token'").withColumn("instance", F.lower("found")).join(found, "instance", "left").drop("instance")
    rows = rows.where("kind is null or base").withColumn("led", F.lit(False)).unionByName(tokens)
    kind = F.when(F.col("base"), F.col("kind")).when(F.col("led"), F.lit("id"))
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, "id"))), kind).cast("int")
    span = F.when(kind.isNotNull(), F.struct("start", rank.alias("rank"), "end", kind.alias("kind"), "found"))
    return rows.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; cases as in ``find_personal_data``."""
    rows = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = line(F.filter("spans", lambda s: s["kind"] != "id"))
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("id").alias("n_found"))

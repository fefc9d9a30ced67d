"""Another way to parse, by window functions over tokens: what the parser is held against."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def parse(lines, internal_labels="ignore"):
    """tokens of accepted trees, and status (tree_id, status, n_leaves) of all."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("newick", r"\[[^\]]*\]", ""), r"\s", ""), ":[^,();]*", "")
    rows = lines.where(F.trim("newick") != "").select("tree_id", F.posexplode(F.regexp_extract_all(text, F.lit("[(),;]|[^(),;]+"), F.lit(0))).alias("i", "tok"))
    line = Window.partitionBy("tree_id").orderBy("i")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_label = ~F.col("tok").isin("(", ")", ",", ";")
    before = F.coalesce(F.lag("tok").over(line), F.lit(""))
    internal = is_label & (before == ")")
    opens, closes = (F.col("tok") == "(").cast("int"), (F.col("tok") == ")").cast("int")
    rows = rows.withColumn("internal", internal).withColumn("leaf", is_label & ~internal)
    bad = (F.col("leaf") & before.isin(";")) | (opens.cast("boolean") & ~before.isin("", "(", ",")) | (F.col("tok").isin(",", ")", ";") & before.isin("(", ",", "", ";"))
    rows = rows.withColumn("misplaced", bad).withColumn("depth", F.sum(opens - closes).over(upto) + closes)
    rows = rows.withColumn("leaves", F.sum(F.col("leaf").cast("int")).over(upto))
    level = Window.partitionBy("tree_id", "depth").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = rows.withColumn("node", F.sum(opens).over(level)).cache()
    nodes = tokens.where("tok in ('(', ',', ')')").groupBy("tree_id", "depth", "node").agg(
        *(F.sum((F.col("tok") == t).cast("int")).alias(n) for t, n in (("(", "o"), (",", "c"), (")", "e"))),
        F.min(F.when(F.col("tok") == "(", F.col("leaves"))).alias("start"), F.max(F.when(F.col("tok") == ")", F.col("leaves"))).alias("end"),
    )
    per_node = nodes.groupBy("tree_id").agg(
        F.bool_and((F.col("o") == 1) & (F.col("e") == 1)).alias("paired"), F.bool_and(F.col("c") == 1).alias("binary"),
        F.sum((F.col("depth") == 1).cast("int")).alias("roots"), F.min(F.when(F.col("depth") == 1, F.col("start"))).alias("start"), F.max(F.when(F.col("depth") == 1, F.col("end"))).alias("end"),
    )
    per_tree = tokens.groupBy("tree_id").agg(
        F.max("leaves").alias("n_leaves"), F.count_distinct(F.when(F.col("leaf"), F.col("tok"))).alias("labels"), F.bool_or("internal").alias("internal"),
        F.bool_or("misplaced").alias("misplaced"), F.sum(opens - closes).alias("open"), F.sum((F.col("tok") == ";").cast("int")).alias("ends"),
    )
    both = per_tree.join(per_node, "tree_id", "left")
    whole = (F.col("roots") == 1) & (F.col("start") == 0) & (F.col("end") == F.col("n_leaves")) & F.col("paired")
    status = (
        F.when((F.col("open") != 0) | (F.col("ends") > 1), "unbalanced")
        .when(F.col("internal") & F.lit(internal_labels == "reject"), "label")
        .when(F.col("n_leaves") == 0, "label")
        .when(F.col("roots").isNull(), F.when((F.col("n_leaves") == 1) & ~F.col("misplaced"), "ok").otherwise("unbalanced"))
        .when(~whole, "unbalanced")
        .when(~F.col("binary"), "not_binary")
        .when(F.col("misplaced"), "label")
        .when(F.col("labels") < F.col("n_leaves"), "duplicate")
        .otherwise("ok")
    )
    status = both.select("tree_id", status.alias("status"), "n_leaves")
    good = tokens.join(status.where("status = 'ok'").select("tree_id"), "tree_id", "left_semi")
    return good.select("tree_id", "i", "tok", "leaf", "depth", "node", "leaves"), status

"""Preparation of training samples: validation, near-duplicate removal, splits, mapping and expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of the multi-label classifier in order, and the domains of sources and difficulties.
LABELS = [
    "hidden-html", "metadata-injection", "dynamic-cloaking", "syntactic-masking", "embedded-jailbreak", "data-exfiltration", "sub-agent-spawning",
    "rag-knowledge-poisoning", "latent-memory-poisoning", "contextual-learning-trap", "biased-framing", "oversight-evasion", "persona-hyperstition", "benign",
]
SOURCES = ["eval-suite", "synthetic", "synthetic-augmented", "benchmark-wasp", "benchmark-agentdojo", "benchmark-jailbreakbench", "benchmark-llmail", "benchmark-ragpoison", "manual"]
DIFFICULTIES = ["easy", "moderate", "hard"]


def validation_errors(text: Column, labels: Column, source: Column, difficulty: Column, sources: list[str] = SOURCES, least: int = 10) -> Column:
    """What is wrong with a sample, as an array of messages."""
    known = F.array(*map(F.lit, LABELS))
    return F.filter(
        F.array(
            F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "text is empty"),
            F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) < least, "text is too short"),
            F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, "no labels"),
            F.when(F.size(F.array_except(labels, known)) > 0, "unknown label"),
            F.when(F.array_contains(labels, "benign") & (F.size(labels) > 1), "benign is exclusive"),
            F.when(~F.coalesce(source.isin(sources), F.lit(False)), "unknown source"),
            F.when(difficulty.isNotNull() & ~difficulty.isin(DIFFICULTIES), "unknown difficulty"),
        ),
        lambda e: e.isNotNull(),
    )


def trigrams(text: Column) -> Column:
    """Distinct word trigrams, lower-cased; a shorter text is one of all its words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))))

    return F.element_at(F.transform(F.array(words), grams), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def similar_pairs(samples: DataFrame, order_col: str, text_col: str = "text", percent: int = 80) -> DataFrame:
    """Pairs (early, late) of samples whose trigram sets reach the similarity. Candidates share one of the first
    trigrams in an order by rarity (prefix filter), so common trigrams are not joined; then sizes and sets decide."""
    sets = samples.select(F.col(order_col).alias("at"), trigrams(F.col(text_col)).alias("g")).withColumn("n", F.size("g"))
    grams = sets.select("at", "n", F.explode("g").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = grams.join(counts, "gram").groupBy("at", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("shared"))
    # grams of one sample only come first in the order, so the prefix loses as many places as there are of them
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - (F.col("n") - F.size("shared"))
    keys = ranked.select("at", "n", F.explode(F.slice("shared", 1, F.greatest(prefix, F.lit(0)))).alias("k")).select("at", "n", "k.gram")
    a, b = keys.select(F.col("at").alias("early"), F.col("n").alias("na"), "gram"), keys.select(F.col("at").alias("late"), F.col("n").alias("nb"), "gram")
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    pairs = a.join(b, "gram").where((F.col("early") < F.col("late")) & near).select("early", "late").distinct()
    left, right = sets.select(F.col("at").alias("early"), F.col("g").alias("ga")), sets.select(F.col("at").alias("late"), F.col("g").alias("gb"))
    return pairs.join(left, "early").join(right, "late").where(jaccard(F.col("ga"), F.col("gb")) * 100 >= percent).select("early", "late")


def drop_near_duplicates(samples: DataFrame, order_col: str, text_col: str = "text", percent: int = 80, rounds: int = 100) -> DataFrame:
    """Samples in order, each kept unless it is similar to an earlier kept one. Found by rounds: a sample whose earlier
    similar samples are all removed is kept, one with a kept earlier similar sample is removed."""
    spark = samples.sparkSession
    pairs = _cut(similar_pairs(samples, order_col, text_col, percent))
    state = _cut(pairs.select(F.explode(F.array("early", "late")).alias("at")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    for _ in range(rounds):
        if state.where("kept IS NULL").isEmpty():
            break
        seen = pairs.join(state.select(F.col("at").alias("early"), F.col("kept").alias("early_kept")), "early")
        verdict = seen.groupBy(F.col("late").alias("at")).agg(F.bool_or(F.coalesce("early_kept", F.lit(False))).alias("near_kept"), F.bool_or(F.col("early_kept").isNull()).alias("open"))
        now = state.join(verdict, "at", "left")
        state = _cut(now.select("at", F.coalesce("kept", F.when(F.col("near_kept"), False).when(~F.coalesce("open", F.lit(False)), True)).alias("kept")))
    else:
        raise RuntimeError("near-duplicate removal did not settle")
    removed = state.where("NOT kept").select(F.col("at").alias(order_col))
    return samples.join(removed, order_col, "left_anti") if spark else samples


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the checkpoint folder that all executors share."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/textward-scratch")
    return df.checkpoint()


def stratified_split(samples: DataFrame, id_col: str = "id", labels_col: str = "labels", seed: int = 42, held_out: Column | None = None) -> DataFrame:
    """samples with split: train, validation or test (80/10/10 in each stratum of first labels, at least one for
    training, rounding half to even). Rows where held_out is true are validation only.

    Places in a stratum follow a hash of the id. They are counted by hash range first, so a stratum that holds most
    rows is spread over many tasks."""
    keyed = samples.withColumns({"_stratum": F.coalesce(F.get(F.col(labels_col), F.lit(0)), F.lit("")), "_hash": F.xxhash64(F.col(id_col), F.lit(seed)), "_held": F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))})
    keyed = keyed.withColumn("_range", F.shiftright("_hash", 54))
    free = keyed.where("NOT _held")
    ranges = free.groupBy("_stratum", "_range").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy("_stratum").orderBy("_range")
    ranges = ranges.select("_stratum", "_range", (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_stratum")).alias("_total"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_stratum", "_range").orderBy("_hash", id_col))
    n_train, n_val = F.greatest(F.lit(1), F.bround(F.col("_total") * 0.8)), F.bround(F.col("_total") * 0.1)
    placed = free.join(ranges, ["_stratum", "_range"]).withColumn("_place", place)
    split = F.when(F.col("_place") <= n_train, "train").when(F.col("_place") <= n_train + n_val, "validation").otherwise("test")
    out = placed.withColumn("split", split).drop("_before", "_total", "_place").unionByName(keyed.where("_held").withColumn("split", F.lit("validation")))
    return out.drop("_stratum", "_hash", "_range", "_held")


def counts(samples: DataFrame) -> DataFrame:
    """kind (label, source, difficulty), value and n."""
    parts = [samples.select(F.lit("label").alias("kind"), F.explode("labels").alias("value")), samples.select(F.lit("source").alias("kind"), F.col("source").alias("value")), samples.select(F.lit("difficulty").alias("kind"), F.col("difficulty").alias("value"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def map_flags(rows: DataFrame, body_col: str, flags_col: str, mapping: dict[str, str], least: int = 20) -> DataFrame:
    """Benchmark rows with JSON objects of boolean flags as samples: text, labels (mapped, of true flags; of none, the
    first mapping's value), success (all flags true). Texts under `least` characters are dropped."""
    flags = F.from_json(F.col(flags_col), "map<string,boolean>")
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    on = F.map_keys(F.map_filter(flags, lambda k, v: v))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(on, lambda k: F.element_at(names, k)), lambda x: x.isNotNull())))
    labels = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit(next(iter(mapping.values())))))
    success = F.coalesce(F.forall(F.map_values(flags), lambda v: v), F.lit(False))
    return rows.withColumns({"text": F.trim(F.col(body_col)), "labels": labels, "success": success}).where(F.length("text") >= least)


def cap_per_label(samples: DataFrame, id_col: str, cap: int, labels: list[str], seed: int = 42) -> DataFrame:
    """At most `cap` samples of each label, successful first, labels in sorted order, a sample used once."""
    out, used = None, None
    for label in sorted(labels):
        free = samples.where(F.array_contains("labels", label))
        free = free if used is None else free.join(used, id_col, "left_anti")
        chosen = _cut(free.orderBy(F.col("success").desc(), F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(cap).withColumn("label", F.lit(label)))
        out = chosen if out is None else out.unionByName(chosen)
        used = out.select(id_col)
    return out


def expand_templates(templates: DataFrame, payloads: DataFrame, n: int) -> DataFrame:
    """n texts: template i mod templates with payload i mod payloads in place of {payload}. Both sides are lists by
    `place` from 0, so every text finds its parts by two equi-joins."""
    spark = templates.sparkSession
    nt, np_ = templates.count(), payloads.count()
    i = spark.range(n).withColumnsRenamed({"id": "i"}).withColumns({"t": F.col("i") % nt, "p": F.col("i") % np_})
    t, p = templates.select(F.col("place").alias("t"), "template"), payloads.select(F.col("place").alias("p"), "payload")
    return i.join(t, "t").join(p, "p").select("i", F.replace("template", F.lit("{payload}"), F.col("payload")).alias("text"))


def entity_encoded(text: Column) -> Column:
    """Every character as a decimal HTML entity."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))), "")

"""Query and entity context of scored pairs, by windows and leave-one-out sums; siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.keys import has_digit
from tessera.sources.stored import stored

STRONG, MID = 0.9, 0.5
#: Sibling thresholds.
SIB_P, SIB_COMMON, SC_P, SC_ENTITIES, SC_RECORDS, SC_TOP = 0.9, 50, 0.9, 2, 20, 3


def _ranked() -> Window:
    return Window.partitionBy("q_id").orderBy(F.desc("p"), "s1_id")


def top2(scored: DataFrame) -> DataFrame:
    """(q_id, s1_id, p1, s1_id2, p2): a query's best and second best; no second: null and 0."""
    r = scored.withColumn("r", F.row_number().over(_ranked())).where("r <= 2")
    at = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    return r.groupBy("q_id").agg(at(1, "s1_id").alias("s1_id"), at(1, "p").alias("p1"), at(2, "s1_id").alias("s1_id2"), F.coalesce(at(2, "p"), F.lit(0.0)).alias("p2"))


def query_context(scored: DataFrame) -> DataFrame:
    """q_rank from 0, q_ncand, q_psum, and q_pother: the best p of the query's other candidates (0: none)."""
    whole = _ranked().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(_ranked()) - 1
    out = scored.withColumns({"q_rank": rank, "q_ncand": F.count("*").over(whole), "q_psum": F.sum("p").over(whole), "_1": F.nth_value("p", 1).over(whole), "_2": F.nth_value("p", 2).over(whole)})
    return out.withColumn("q_pother", F.coalesce(F.when(F.col("q_rank") == 0, F.col("_2")).otherwise(F.col("_1")), F.lit(0.0))).drop("_1", "_2")


def entity_context(ranked: DataFrame) -> DataFrame:
    """Of the other queries whose best candidate is the entity: counts by strength and feed (e_same_src_strong: of the row's own), sum, number, most; of all other pairs: sum and number.

    One aggregate by entity, then each row's own part is taken off. Needs query_context.
    """
    s3 = F.substring("q_id", 2, 1) == "3"
    base = ranked.withColumn("src3", s3.cast("int"))
    strong, mid = F.col("p") >= STRONG, F.col("p") >= MID
    best = base.where("q_rank = 0").groupBy("s1_id").agg(
        F.count_if(strong).alias("t_strong"), F.count_if(strong & ~s3).alias("t_s2"), F.count_if(strong & s3).alias("t_s3"), F.count_if(mid).alias("t_mid"), F.sum("p").alias("t_sum"), F.count("*").alias("t_n"),
        F.max("p").alias("t_max"), F.count("*").alias("_n"),
    )
    second = base.where("q_rank = 0").withColumn("r", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("p"), "q_id"))).where("r = 2").select("s1_id", F.col("p").alias("t_second"))
    every = base.groupBy("s1_id").agg(F.sum("p").alias("t_all"), F.count("*").alias("t_pairs"))
    t = base.join(best.drop("_n"), "s1_id", "left").join(second, "s1_id", "left").join(every, "s1_id").na.fill(0, ["t_strong", "t_s2", "t_s3", "t_mid", "t_n"]).na.fill(0.0, ["t_sum", "t_max", "t_second"])
    own = F.col("q_rank") == 0
    less = lambda total, cond, by=F.lit(1): F.col(total) - F.when(own & cond, by).otherwise(F.lit(0))
    yes = F.lit(True)
    most = F.when(own & (F.col("p") == F.col("t_max")), F.col("t_second")).otherwise(F.col("t_max"))
    out = t.withColumns({
        "e_strong": less("t_strong", strong), "e_strong_s2": less("t_s2", strong & ~s3), "e_strong_s3": less("t_s3", strong & s3), "e_mid": less("t_mid", mid), "e_sum": less("t_sum", yes, F.col("p")), "e_n": less("t_n", yes),
        "e_same_src_strong": F.when(s3, less("t_s3", strong & s3)).otherwise(less("t_s2", strong & ~s3)), "e_max": most, "e_all_sum": F.col("t_all") - F.col("p"), "e_all_n": F.col("t_pairs") - 1,
    })
    return out.drop(*[c for c in out.columns if c.startswith("t_")])


def context_features(best: DataFrame) -> DataFrame:
    """The context of each query's best pair (needs top2): what else points to the entity, and what leaks to it as second best."""
    leak = best.where("s1_id2 is not null").groupBy(F.col("s1_id2").alias("s1_id")).agg(F.sum("p2").alias("leak"))
    scored = best.select("q_id", "s1_id", F.col("p1").alias("p")).withColumn("q_rank", F.lit(0))
    ctx = entity_context(scored).select("q_id", "e_strong", "e_strong_s2", "e_strong_s3", "e_mid", "e_sum", "e_n", "e_max", "src3")
    out = best.join(ctx, "q_id").join(leak, "s1_id", "left").withColumn("leak", F.coalesce("leak", F.lit(0.0)))
    return out.withColumns({"gap": F.col("p1") - F.col("p2"), "n_src": F.when(F.col("src3") == 1, F.col("e_strong_s3")).otherwise(F.col("e_strong_s2"))})


def divergences(t: DataFrame, reference: DataFrame) -> DataFrame:
    """(q_id, s1_id, p, q_rank, src3, nd, ad): the query's words that the entity lacks and that are not common in the country's reference (words of addresses with a digit never count as common)."""

    def field(text: str, c: str, numbers_stay: bool) -> DataFrame:
        common = reference.select("country", F.explode(F.array_distinct(X.split_words(F.col(text)))).alias("w")).groupBy("country", "w").agg(F.count("*").alias("df")).where(F.col("df") > SIB_COMMON)
        common = common.where(~has_digit(F.col("w"))) if numbers_stay else common
        rest = F.array_except(X.split_words(F.col(f"{c}2")), X.split_words(F.col(f"{c}1")))
        each = t.select("q_id", "s1_id", "country", F.explode(rest).alias("w")).join(common, ["country", "w"], "left_anti")
        return each.groupBy("q_id", "s1_id").agg(F.array_sort(F.collect_set("w")).alias(f"{c}d"))

    none = F.array().cast("array<string>")
    src3 = (F.substring("q_id", 2, 1) == "3").cast("int").alias("src3")
    out = t.select("q_id", "s1_id", "p", "q_rank", src3).join(field("name_n", "n", False), ["q_id", "s1_id"], "left").join(field("addr_n", "a", True), ["q_id", "s1_id"], "left")
    return out.withColumns({"nd": F.coalesce("nd", none), "ad": F.coalesce("ad", none)})


def sibling_features(t: DataFrame, reference: DataFrame) -> DataFrame:
    """(q_id, s1_id) with the numbers of rare divergences of address and name (q_addr_rdiv, q_name_rdiv) and the most of them
    that another sure record of the entity shares: in the address (sib_addr_shared), of the same feed (sib_addr_shared_same),
    in the name (sib_name_shared). 0 without. Needs texts and query_context.

    Records of an entity and feed with the same divergences are one variant, and only variants that share a word meet,
    so an entity with many records costs as much as its different divergences.
    """
    d = stored(divergences(t, reference).withColumn("sure", ((F.col("q_rank") == 0) & (F.col("p") >= SIB_P)).cast("int")))
    out = d.withColumns({"q_addr_rdiv": F.size("ad"), "q_name_rdiv": F.size("nd")})
    for words, every, same in (("ad", "sib_addr_shared", "sib_addr_shared_same"), ("nd", "sib_name_shared", None)):
        kinds = d.where(F.size(words) > 0).groupBy("s1_id", "src3", words).agg(F.sum("sure").alias("n"))
        each = kinds.select("s1_id", "src3", words, "n", F.explode(words).alias("w"))
        x, y = each.alias("x"), each.where("n > 0").alias("y")
        other = (F.col("x.src3") != F.col("y.src3")) | (F.col(f"x.{words}") != F.col(f"y.{words}"))
        met = x.join(y, (F.col("x.s1_id") == F.col("y.s1_id")) & (F.col("x.w") == F.col("y.w")) & other)
        shared = met.groupBy("x.s1_id", "x.src3", f"x.{words}", F.col("y.src3").alias("of"), F.col(f"y.{words}").alias("theirs")).agg(F.count("*").alias("c"))
        most = shared.groupBy("s1_id", "src3", words).agg(F.max("c").alias("_every"), F.max(F.when(F.col("src3") == F.col("of"), F.col("c"))).alias("_same"))
        out = out.join(kinds, ["s1_id", "src3", words], "left").join(most, ["s1_id", "src3", words], "left")
        twin = F.when(F.col("n") > F.col("sure"), F.size(words))  # a sure record with just the same divergences
        best = lambda c: F.coalesce(F.greatest(F.col(c), twin), F.lit(0)).cast("int")  # noqa: B023, E731
        out = out.withColumns({every: best("_every")} | ({same: best("_same")} if same else {})).drop("n", "_every", "_same")
    return out.select("q_id", "s1_id", "q_addr_rdiv", "sib_addr_shared", "sib_addr_shared_same", "q_name_rdiv", "sib_name_shared")


def sibling_keys(queries: DataFrame) -> DataFrame:
    """(country, q_id, src, key): the sorted address bag (3 words or more, one with a digit), and house numbers of two digits or more with the record's 2 rarest plain words."""
    w = X.split_words(F.col("addr_n"))
    src = F.substring("id", 2, 1).alias("src")
    bags = queries.where((F.size(w) >= 3) & F.exists(w, has_digit)).select("country", F.col("id").alias("q_id"), src, F.concat(F.lit("b:"), F.array_join(F.array_sort(w), " ")).alias("key"))
    each = queries.select("country", "id", src, F.explode(F.array_distinct(F.filter(w, lambda t: ~has_digit(t)))).alias("t"))
    df = each.groupBy("country", "t").agg(F.count("*").alias("df"))
    top = each.join(df, ["country", "t"]).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))).where("r <= 2").select("country", "id", "src", "t")
    runs = queries.select("id", F.explode(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("addr_n", F.lit(r"(?U)\d+"), F.lit(0)), lambda x: F.regexp_replace(x, "^0+", "")), lambda x: F.length(x) >= 2))).alias("h"))
    numbered = top.join(runs, "id").select("country", F.col("id").alias("q_id"), "src", F.concat(F.lit("h:"), F.col("h"), F.lit("_"), F.col("t")).alias("key"))
    return bags.unionByName(numbered)


def sibling_candidates(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_id, s1_id, sc_n, sc_keys): entities of sure records of the same country and feed that share a rare enough key; the best SC_TOP of a query."""
    by = ["country", "src", "key"]
    keys = stored(sibling_keys(queries))
    rare = keys.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") <= SC_RECORDS)
    keys = stored(keys.join(rare, by).drop("n"))
    placed = scored.withColumn("r", F.row_number().over(_ranked())).where((F.col("r") == 1) & (F.col("p") >= SC_P)).select(F.col("q_id").alias("o_id"), "s1_id")
    held = keys.select(F.col("q_id").alias("o_id"), *by).join(placed, "o_id")
    few = held.groupBy(*by).agg(F.countDistinct("s1_id").alias("e")).where(F.col("e") <= SC_ENTITIES).select(*by)
    met = keys.select("q_id", *by).join(held.join(few, by), by).where("q_id <> o_id")
    pairs = met.groupBy("q_id", "s1_id").agg(F.countDistinct("o_id").alias("sc_n"), F.countDistinct("key").alias("sc_keys"))
    order = Window.partitionBy("q_id").orderBy(F.desc("sc_n"), F.desc("sc_keys"), "s1_id")
    return pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SC_TOP).drop("r")


def add_sibling_candidates(scored: DataFrame, found: DataFrame) -> DataFrame:
    """Scored pairs with sibling evidence, and the new pairs with p 0 and sc_new 1."""
    old = scored.join(found, ["q_id", "s1_id"], "left").withColumn("sc_new", F.lit(0))
    new = found.join(scored, ["q_id", "s1_id"], "left_anti").withColumns({"p": F.lit(0.0), "sc_new": F.lit(1)})
    return old.unionByName(new, allowMissingColumns=True).na.fill(0, ["sc_n", "sc_keys"])


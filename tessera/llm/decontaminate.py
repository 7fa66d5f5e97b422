"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

For every window of a benchmark item its two rarest terms over the whole corpus are found. The index stores the
postings of these terms: (term, document, position). Lists are intersected adjusted by offset, rarest term first: a
posting of the rarest says where the item would begin, and the second must have a posting at its offset from there.
Windows of an item with the same two terms in the same places are looked up once. What is left is compared word by
word with the document. The same lists, intersected by document, answer proximity searches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, lower_ascii, stored, table

WINDOW = 10
#: Rows are broadcast up to so many bytes, counted; beyond, they are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Postings of a term that one part of it holds; the phrases that look it up are copied for every part.
HOT = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def mark(text: str) -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.col(text).cast("string"))


def words(text: str) -> Column:
    """A-Z in lower case, then maximal runs of a-z, 0-9 and characters beyond ASCII. Null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))), NOT_WORD), "")


def distinct_items(items: DataFrame) -> DataFrame:
    """(item, w, items): the different word lists, numbered, and the ids (as strings) of the items that have them. Items without words are left out."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where("size(w) > 0")
    return stored(stored(w.groupBy("w").agg(F.collect_set("item_id").alias("items"))).withColumn("item", F.monotonically_increasing_id()))


def small(rows: DataFrame, size: Column) -> DataFrame:
    """``rows``, to be broadcast if ``size``, summed over them, allows it."""
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else rows


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` stands in all documents, if it does."""
    return docs.select(F.explode(words("text")).alias("term")).join(small(terms, F.octet_length("term") + 16), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, mark, position from 0) of ``terms``."""
    rows = docs.select("doc_id", mark("text").alias("mark"), F.posexplode(words("text")).alias("position", "term"))
    return rows.join(small(terms, F.octet_length("term") + 16), "term", "left_semi").select("term", "doc_id", "mark", "position")


def lookups(items: DataFrame, counts: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, item, t1, n1, o1, t2, n2, o2, starts) for items (item, w): the two rarest different terms of every window of ``size`` words
    (all words, if there are fewer) and their offsets in the item, with the starts of all windows that have them there.

    Ties go to the earlier word. A window of one different word has no t2; one with a word that stands nowhere is left out.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size))
    each = items.select("item", "w", F.explode(starts).alias("s")).select("item", "s", F.posexplode(F.slice("w", F.col("s") + 1, F.lit(size))).alias("o", "t"))
    first = each.groupBy("item", "s", "t").agg(F.min("o").alias("o")).join(small(counts, F.octet_length("term") + 24), F.col("t") == F.col("term"), "left")
    ranked = first.groupBy("item", "s").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "t"))).alias("r"))
    at = lambda k: [F.get("r", F.lit(k))["t"].alias(f"t{k + 1}"), F.get("r", F.lit(k))["n"].alias(f"n{k + 1}"), (F.get("r", F.lit(k))["o"] + F.col("s")).alias(f"o{k + 1}")]
    two = ranked.select("item", "s", *at(0), *at(1)).where("n1 > 0")
    return stored(stored(two.groupBy("item", "t1", "n1", "o1", "t2", "n2", "o2").agg(F.collect_list("s").alias("starts"))).withColumn("id", F.monotonically_increasing_id()))


def _same(*columns: str) -> Column:
    out = F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.mark") == F.col("p.mark"))
    for f, p in zip(columns[::2], columns[1::2], strict=True):
        out = out & (F.col(f"f.{f}") == F.col(f"p.{p}"))
    return out


def looked_up(index: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` (t1, n1, ...) with the postings of t1. A term with many postings is dealt out in parts."""
    parts = F.greatest(F.ceil(F.col("n1") / HOT), F.lit(1)).cast("int")
    by = plan.withColumns({"parts": parts, "part": F.explode(F.sequence(F.lit(0), parts - 1))})
    hot = by.select(F.col("t1").alias("term"), "parts").where("parts > 1").distinct()
    dealt = index.join(small(hot, F.octet_length("term") + 24), "term", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "mark"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return dealt.withColumnRenamed("term", "t1").join(small(by.drop("parts"), F.lit(100)), ["t1", "part"]).drop("part")


def aligned(index: DataFrame, plan: DataFrame) -> DataFrame:
    """(id, doc_id, mark, shift): where both terms of a lookup stand as in the item, which would begin at word ``shift`` (before the document, if negative)."""
    found = looked_up(index, plan.select("id", "t1", "n1", "o1", "t2", "o2"))
    found = found.select("id", "doc_id", "mark", "t2", (F.col("position") - F.col("o1")).alias("shift"), (F.col("position") - F.col("o1") + F.col("o2")).alias("at"))
    both = found.where("t2 is not null").alias("f").join(index.alias("p"), _same("t2", "term", "at", "position"), "left_semi")
    return both.unionByName(found.where("t2 is null")).select("id", "doc_id", "mark", "shift").distinct()


def together(index: DataFrame, pairs: DataFrame, within: int = WINDOW - 1) -> DataFrame:
    """(t1, t2, doc_id, mark): documents that hold both terms of a pair (t1, n1, t2) at most ``within`` words apart, by their lists of positions."""
    held = stored(index.groupBy("term", "doc_id", "mark").agg(F.sort_array(F.collect_set("position")).alias("position")))
    one = looked_up(held, pairs).select("t1", "t2", "doc_id", "mark", "position")
    close = F.exists("f.position", lambda a: F.exists("p.position", lambda b: F.abs(a - b) <= within))
    return one.alias("f").join(held.alias("p"), _same("t2", "term") & close, "left_semi").select("t1", "t2", "doc_id", "mark")


def _planned(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(lookups, index) of items (item, w) over ``docs``."""
    counts = stored(term_counts(docs, items.select(F.explode("w").alias("term")).distinct()))
    plan = lookups(items, counts, size)
    terms = plan.select(F.explode(F.array("t1", "t2")).alias("term")).where("term is not null").distinct()
    return plan, stored(postings(docs, terms))


def proximity_matches(docs: DataFrame, pairs: DataFrame, within: int = WINDOW - 1) -> DataFrame:
    """(doc_id, a, b): documents with the words ``a`` and ``b`` at most ``within`` words apart. A pair of one word, or with null, matches nothing."""
    pairs = stored(pairs.select("a", "b").where("a is not null and b is not null and a <> b").distinct().withColumn("item", F.xxhash64("a", "b")))
    plan, index = _planned(docs, pairs.select("item", F.array("a", "b").alias("w")))
    found = together(index, plan.where("n2 > 0").select("t1", "n1", "t2").distinct(), within)
    in_order = pairs.select("a", "b", F.array_sort(F.array("a", "b")).alias("two"))
    return found.select("doc_id", F.array_sort(F.array("t1", "t2")).alias("two")).distinct().join(in_order, "two").select("doc_id", "a", "b")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, mark, n_words, n_hit, n_items, item_ids, contaminated, n_near.

    A word is hit if it lies inside an occurrence of a window of any item. ``n_near`` counts the items of which some
    window has its two rarest words in the text, at most WINDOW - 1 words apart. Null and empty texts have no words;
    an empty benchmark hits nothing; items without words or text have no windows. Rows are judged by their own text:
    neither a shared nor a null doc_id passes hits on.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = distinct_items(benchmark)
    plan, index = _planned(docs, items.select("item", "w"))
    full = plan.join(items, "item").select("id", "w", "starts", "items")
    place = aligned(index, plan).join(small(full, 24 * F.size("w") + 8 * F.size("starts") + 40 * F.size("items")), "id")
    exact = place.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("shift", "w", "starts", "items")).alias("held"))
    pairs = stored(plan.where("t2 is not null").join(items, "item").groupBy("t1", "n1", "t2").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))
    both = together(index, pairs.select("t1", "n1", "t2")).join(small(pairs.drop("n1"), 40 * F.size("items") + 60), ["t1", "t2"])
    close = both.groupBy("doc_id", "mark").agg(F.size(F.array_distinct(F.flatten(F.collect_set("items")))).cast("long").alias("n_near"))
    exact, close = stored(exact), stored(close)
    dropped(index)
    # only documents with a candidate meet their candidates; of all others no text is shuffled
    weight = F.aggregate("held", F.lit(60), lambda a, x: a + 60 + 24 * F.size(x["w"]) + 40 * F.size(x["items"]))
    own = docs.select("doc_id", mark("text").alias("mark"), "text").alias("f").join(small(exact.select("doc_id", "mark"), F.lit(16)).alias("p"), _same(), "left_semi")
    rows = own.alias("p").join(small(exact, weight).alias("f"), _same()).select("p.doc_id", "p.mark", words("text").alias("words"), "held")

    def hits(h: Column) -> Column:
        size = F.least(F.lit(WINDOW), F.size(h["w"]))
        stands = lambda s: (h["shift"] + s >= 0) & (F.slice("words", F.greatest(h["shift"] + s + 1, F.lit(1)), size) == F.slice(h["w"], s + 1, size))
        return F.transform(F.filter(h["starts"], stands), lambda s: F.struct((h["shift"] + s).alias("start"), size.alias("size"), h["items"].alias("items")))

    rows = rows.withColumn("hits", F.flatten(F.transform("held", hits)))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))
    n_hit = F.coalesce(F.size(covered), F.lit(0)).cast("long")
    ids = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.col("hits.items")))), F.array().cast("array<string>"))
    hit = rows.select("doc_id", "mark", n_hit.alias("n_hit"), ids.alias("item_ids")).where("n_hit > 0").dropDuplicates(["doc_id", "mark"])
    result = hit.alias("f").join(close.alias("p"), _same(), "full")
    none = F.array().cast("array<string>")
    result = stored(result.select(F.coalesce("f.doc_id", "p.doc_id").alias("doc_id"), F.coalesce("f.mark", "p.mark").alias("mark"), "n_hit", F.coalesce("item_ids", none).alias("item_ids"), "n_near"))
    every = docs.select("doc_id", mark("text").alias("mark"), F.size(words("text")).cast("long").alias("n_words")).alias("p").join(small(result, 40 * F.size("item_ids") + 60).alias("f"), _same(), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    every = every.select("p.doc_id", "p.mark", "n_words", zero("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), zero("n_near"))
    return every.select("doc_id", "mark", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


QUERIES = {"op3_decontaminate": op3_decontaminate}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op3_decontaminate": f"""
with iw as (select item_id, {_WORDS} as w from benchmark),
win as (
  select distinct item_id, len(w[s : s + 9]) as n, array_to_string(w[s : s + 9], ' ') as p
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as s from iw where len(w) > 0)),
dw as (select doc_id, {_WORDS} as w from documents),
dg as (
  select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as p
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from dw, (select distinct n from win))),
m as (select doc_id, s, n, item_id from dg join win using (n, p)),
h as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(s, s + n)) as x from m) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from m) group by doc_id),
dp as (select doc_id, unnest(w) as t, unnest(range(0, len(w))) as pos from dw),
cnt as (select t, count(*) as c from dp group by t),
tw as (select p, t, min(o) as o from (select p, unnest(string_split(p, ' ')) as t, unnest(range(0, n)) as o from (select distinct p, n from win)) group by p, t),
rk as (select p, t, coalesce(c, 0) as c, row_number() over (partition by p order by coalesce(c, 0), o) as r from tw left join cnt using (t)),
two as (select a.p, a.t as t1, b.t as t2 from rk a join rk b on a.p = b.p and a.r = 1 and b.r = 2 and a.c > 0),
nr as (select distinct x.doc_id, p from two join dp x on x.t = t1 join dp y on y.t = t2 and y.doc_id = x.doc_id and abs(x.pos - y.pos) <= 9),
ni as (select doc_id, count(distinct item_id) as n_near from nr join win using (p) group by doc_id)
select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from dw left join h using (doc_id) left join i using (doc_id) left join ni using (doc_id)"""
}

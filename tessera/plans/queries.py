"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.similarity import kernels
from tessera.operators import aliases, blocking, boosting, channel, context, decode, rawcheck, training
from tessera.operators import features as feats
from tessera.operators import keys as K
from tessera.plans import linkage, rerank
from tessera.sources.records import bucket, documents, parties, scored
from tessera.sources.stored import shared_dir, stored

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def _round(*names: str) -> list[Column]:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def _reference(spark, sf):
    return parties(spark, sf).where("role = 0")


def _queries(spark, sf):
    return parties(spark, sf).where("role > 0")


def _sides(spark, sf):
    """(reference, queries), stored once for plans that read them again and again."""
    p = stored(parties(spark, sf))
    return p.where("role = 0"), p.where("role > 0")


def _truth(spark, sf):
    return _queries(spark, sf).where("owner is not null").select(F.col("owner").alias("s1"), F.col("id").alias("other"))


def _pairs(spark, sf):
    """True pairs with both texts."""
    p = _queries(spark, sf).where("owner is not null").select(F.col("id").alias("q_id"), F.col("owner").alias("s1_id"))
    return feats.with_texts(p, _reference(spark, sf), _queries(spark, sf))


# text


@query
def norm_names(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", X.norm_name(F.concat_ws(" & ", F.initcap("p_name"), "p_brand", "p_type", "p_type")).alias("x")).select("p_partkey", "x.name", "x.is_domain")


@query
def norm_addresses(spark, sf):
    raw = F.concat(F.lit("00"), F.col("c_custkey").cast("string"), F.lit(", N/A, "), F.col("c_mktsegment"), F.lit(" - "), F.col("c_name"))
    return _t(spark, sf, "customer").select("c_custkey", X.norm_addr(raw).alias("addr"))


@query
def fold_documents(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(X.fold(F.col("text")).cast("binary")).alias("folded_md5"))


@query
def domain_names(spark, sf):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return _t(spark, sf, "pages").select("page_id", X.norm_name(host).alias("x")).select("page_id", "x.name", "x.is_domain")


@query
def leet_tokens(spark, sf):
    word = F.concat(F.lit("b"), F.col("p_partkey").cast("string"), F.lit("r"))
    return _t(spark, sf, "part").select("p_partkey", X.leet(word).alias("word"), X.leet(F.col("p_partkey").cast("string")).alias("number"), X.leet(F.concat(F.col("p_partkey").cast("string"), F.lit("th"))).alias("ordinal"))


@query
def native_flags(spark, sf):
    return aliases.native_flags(parties(spark, sf)).select("id", "native_name", "native_addr")


@query
def party_records(spark, sf):
    return parties(spark, sf).select("id", "country", "name_n", "addr_n", "name_sq", "role", "owner")


@query
def document_records(spark, sf):
    return documents(spark, sf).select("id", "country", "name_n", "addr_n", "name_sq", "role")


# keys


@query
def token_df(spark, sf):
    return K.vocabulary(_reference(spark, sf), X.split_words(F.col("addr_n")))


def _keys(spark, sf, keys):
    # a small file is one task: its rows are dealt out before the work
    return parties(spark, sf).repartition("id").select("id", F.explode(F.array_distinct(keys)).alias("key"))


@query
def keys_token(spark, sf):
    return _keys(spark, sf, F.concat(K.token_keys("n", X.split_words(F.col("name_n"))), K.token_keys("a", X.split_words(F.col("addr_n")))))


@query
def keys_bigram(spark, sf):
    return _keys(spark, sf, K.bigram_keys(X.split_words(F.col("name_n"))))


@query
def keys_squash(spark, sf):
    return _keys(spark, sf, K.squash_keys(F.col("name_sq"), K.KeyConfig()))


@query
def keys_addrbag(spark, sf):
    return _keys(spark, sf, K.bag_keys(X.split_words(F.col("addr_n"))))


@query
def keys_numword(spark, sf):
    return _keys(spark, sf, K.number_word_keys(X.split_words(F.col("addr_n"))))


@query
def keys_cross(spark, sf):
    return _keys(spark, sf, K.cross_keys(X.split_words(F.col("name_n")), X.split_words(F.col("addr_n"))))


@query
def keys_rarepair(spark, sf):
    ref = _reference(spark, sf)
    return K.rare_pair_keys(_queries(spark, sf), K.vocabulary(ref, X.split_words(F.col("addr_n"))), 5).select("id", "key")


@query
def index_capped(spark, sf):
    return blocking.build_index(_reference(spark, sf)).keys.select("id", "country", "key", "df")


@query
def candidates_topk(spark, sf):
    """The flagship: the best five reference records for every noisy record, by all key families."""
    return blocking.generate_candidates(*_sides(spark, sf), 5).select("q_id", "s1_id", *_long("n_keys"), *_round("score"))


def _candidates(spark, sf):
    return blocking.generate_candidates(*_sides(spark, sf), 10)


@query
def candidates_all_keys(spark, sf):
    return _candidates(spark, sf).select("q_id", "s1_id", *_long("n_keys", *blocking.FAMILIES.values()), *_round("score", "max_idf"))


@query
def v2_namebag_keys(spark, sf):
    return _keys(spark, sf, K.bag_subset_keys(F.col("name_n"), F.array(F.lit("brand")), 2, ("nb",)))


@query
def v2_anagram_keys(spark, sf):
    return _keys(spark, sf, K.bag_subset_keys(F.col("name_n"), F.array(F.lit("brand")), 2, ("ag",)))


@query
def v2_typo_keys(spark, sf):
    return _keys(spark, sf, K.typo_keys(F.col("name_n"), F.array(F.lit("brand"))))


@query
def v2_house_keys(spark, sf):
    return _keys(spark, sf, K.house_numbers(F.col("addr_n")))


@query
def v2_cross_keys(spark, sf):
    ref, q = _sides(spark, sf)
    cfg = K.CorruptionConfig()
    words = blocking.corruption_words(ref, cfg)
    return K.corruption_keys(q, words.names, words.words, words.stop, False, cfg, name_families=False).select("id", "key")


@query
def v2_hits(spark, sf):
    ref, q = _sides(spark, sf)
    return blocking.corruption_hits(blocking.build_corruption_index(ref), q).select("q_id", "s1_id", *_long("v2_nkeys", "v2_k_nb", "v2_k_ag", "v2_k_hn", "v2_k_cx", "v2_k_sw", "v2_k_ty"), *_round("v2_score", "v2_max_idf"))


def _union(spark, sf):
    ref, q = _sides(spark, sf)
    return blocking.query_union(blocking.build_index(ref), blocking.build_corruption_index(ref), q, 10, 5)


@query
def candidates_union(spark, sf):
    return _union(spark, sf).select("q_id", "s1_id", *_long("in_v1", "in_v2", "n_keys", "v2_nkeys"), *_round("score", "v2_score"))


@query
def blocking_recall(spark, sf):
    return blocking.recall_report(_candidates(spark, sf), _truth(spark, sf), _queries(spark, sf)).select("country", *_long("n_true", "n_found", "missed_blank", "missed_native", "missed_domain"), *_round("recall", "recall_blank", "recall_native", "recall_domain", "per_query"))


# aliases


@query
def alias_fit(spark, sf):
    return aliases.fit_aliases(_pairs(spark, sf), 2, 0.3).select("field", "q_tok", "s_tok", *_long("cnt", "total"), *_round("purity"))


@query
def alias_apply(spark, sf):
    table = spark.createDataFrame([("n", "small", "little", 9, 9, 1.0), ("a", "nation", "land", 9, 9, 1.0), ("n", "ring", "band", 9, 9, 1.0)], "field string, q_tok string, s_tok string, cnt long, total long, purity double")
    return aliases.apply_aliases(parties(spark, sf), table, "all").select("id", "name_n", "addr_n", "name_sq")


@query
def alias_classes(spark, sf):
    table = spark.createDataFrame([("n", "small", "tiny", 20, 20, 1.0), ("n", "tiny", "little", 20, 20, 1.0), ("n", "bolt", "b0lt", 20, 20, 0.9), ("n", "red", "rot", 5, 5, 1.0)], "field string, q_tok string, s_tok string, cnt long, total long, purity double")
    return aliases.canonical(parties(spark, sf), aliases.alias_classes(table)).select("id", "name_n", "name_sq")


# features


@query
def s1_ambiguity(spark, sf):
    return feats.s1_ambiguity(_reference(spark, sf)).select("id", *_long("s1_name_dup", "s1_addr_dup"))


@query
def leftover_tokens(spark, sf):
    return feats.leftover_features(_pairs(spark, sf)).select("q_id", "s1_id", "nr1", "nr2", "ar1", "ar2", "mr1", "mr2")


@query
def levenshtein_rest(spark, sf):
    t = feats.rest_features(feats.leftover_features(_pairs(spark, sf)))
    return t.select("q_id", *_long("n_rest_len1", "n_rest_len2", "a_rest_len1", "a_rest_len2", "m_rest_len1", "m_rest_len2", "m_rest_dist"))


@query
def token_overlap(spark, sf):
    return feats.token_features(_pairs(spark, sf)).select("q_id", *_long("n_shared_tok", "a_shared_tok", "n1_ntok", "n2_ntok", "a1_ntok", "a2_ntok"))


@query
def number_features(spark, sf):
    return feats.number_features(_pairs(spark, sf)).select("q_id", *_long("num_inter", "num1", "num2", "num_first_eq"))


@query
def flag_features(spark, sf):
    return feats.flag_features(_pairs(spark, sf)).select("q_id", *_long("src3", "q_is_domain", "q_addr_empty", "n_exact", "a_exact", "n1_len", "n2_len", "a1_len", "a2_len", "q_native_name", "q_native_addr"), *_round("n_len_ratio", "a_len_ratio"))


@query
def jaro_winkler(spark, sf):
    return _pairs(spark, sf).withColumn("k", kernels(F.col("a1"), F.col("a2"), "jw")).select("q_id", F.round("k.jw", 6).alias("a_jw"))


@query
def indel_ratio(spark, sf):
    t = _pairs(spark, sf).withColumn("k", kernels(F.col("n1"), F.col("n2"), "ratio", "tsort"))
    return t.select("q_id", F.round("k.ratio", 6).alias("n_ratio"), F.round("k.tsort", 6).alias("n_tsort"))


@query
def token_set_ratio(spark, sf):
    t = _pairs(spark, sf).withColumn("k", kernels(F.col("a1"), F.col("a2"), "tset", "ptset"))
    return t.select("q_id", F.round("k.tset", 6).alias("a_tset"), F.round("k.ptset", 6).alias("a_partial"))


@query
def partial_ratio(spark, sf):
    t = _pairs(spark, sf).withColumn("k", kernels(F.col("q1"), F.col("q2"), "partial"))
    return t.select("q_id", F.round("k.partial", 6).alias("sq_partial"))


@query
def pair_features(spark, sf):
    ref, q = _sides(spark, sf)
    return feats.pair_features(blocking.generate_candidates(ref, q, 3).select("q_id", "s1_id", "n_keys", "score"), ref, q).drop("n1", "n2", "a1", "a2")


@query
def house_number_relations(spark, sf):
    return feats.house_number_relations(_pairs(spark, sf)).select("q_id", *_round("hn_diff", "hn_logdiff"), *_long("hn_prefix", "hn_suffix", "hn_lendiff"))


@query
def vocab_features(spark, sf):
    return feats.vocab_features(_pairs(spark, sf), _reference(spark, sf)).select("q_id", *_round("v_min", "v_max"), *_long("v_unknown", "v_known"))


@query
def cross_encoder_texts(spark, sf):
    return feats.pair_texts(_pairs(spark, sf)).select("q_id", "text1", "text2")


# context


@query
def top2(spark, sf):
    return context.top2(scored(spark, sf))


@query
def query_context(spark, sf):
    return context.query_context(scored(spark, sf)).select("q_id", "s1_id", *_long("q_rank", "q_ncand"), *_round("p", "q_psum", "q_pother"))


@query
def entity_context(spark, sf):
    return context.entity_context(context.query_context(scored(spark, sf))).select("q_id", "s1_id", *_long("e_strong", "e_strong_s2", "e_strong_s3", "e_mid", "e_n", "e_all_n", "e_same_src_strong", "src3"), *_round("e_sum", "e_max", "e_all_sum"))


@query
def context_features(spark, sf):
    return context.context_features(context.top2(scored(spark, sf))).select("q_id", "s1_id", *_long("e_strong", "e_mid", "e_n", "n_src"), *_round("e_sum", "e_max", "leak", "gap"))


def _party_scores(spark, sf):
    """True pairs and a wrong neighbour of each, with a fixed p."""
    p = _queries(spark, sf).where("owner is not null").select(F.col("id").alias("q_id"), F.col("owner").alias("s1_id"), (F.lit(0.85) + bucket(F.col("id"), 7, 15) / 100).alias("p"))
    wrong = p.select("q_id", F.concat(F.lit("S1-"), (F.substring("s1_id", 4, 20).cast("long") + 1).cast("string")).alias("s1_id"), (F.col("p") - 0.5).alias("p"))
    return p.unionByName(wrong.join(_reference(spark, sf).select(F.col("id").alias("s1_id")), "s1_id", "left_semi").select("q_id", "s1_id", "p"))


@query
def sibling_features(spark, sf):
    t = feats.with_texts(context.query_context(_party_scores(spark, sf)), _reference(spark, sf), _queries(spark, sf))
    return context.sibling_features(t, _reference(spark, sf)).select("q_id", "s1_id", *_long("q_addr_rdiv", "sib_addr_shared", "sib_addr_shared_same", "q_name_rdiv", "sib_name_shared"))


@query
def sibling_candidates(spark, sf):
    return context.sibling_candidates(_party_scores(spark, sf), _queries(spark, sf)).select("q_id", "s1_id", *_long("sc_n", "sc_keys"))


@query
def sibling_pairs_added(spark, sf):
    s = _party_scores(spark, sf)
    return context.add_sibling_candidates(s, context.sibling_candidates(s, _queries(spark, sf))).select("q_id", "s1_id", *_round("p"), *_long("sc_n", "sc_keys", "sc_new"))


# channel


def _events(spark, sf):
    """Order lines as pairs with word events and a label, events being their codes."""
    line = _t(spark, sf, "lineitem")
    ev = lambda g, c: F.struct(F.lit(g).alias("g"), F.col(c).cast("string").alias("event"))
    return line.select(F.col("l_orderkey").cast("string").alias("q_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("s1_id"), (F.col("l_quantity") > 25).cast("int").alias("label"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.array(ev("nop", "l_returnflag"), ev("aop", "l_linestatus"), ev("nins", "l_suppkey")).alias("events"))


@query
def channel_llr_table(spark, sf):
    return channel.llr_table(_events(spark, sf)).select("g", "event", *_long("pos", "neg"), *_round("llr"))


@query
def channel_fold_tables(spark, sf):
    return channel.fold_tables(_events(spark, sf)).select(F.col("fold").cast("long").alias("fold"), "g", "event", *_long("pos", "neg"), *_round("llr"))


@query
def channel_features(spark, sf):
    ev = _events(spark, sf)
    return channel.channel_features(ev, channel.llr_table(ev)).select("q_id", "s1_id", *_round("nop_sum", "nop_min", "nins_sum", "nins_min"), *_long("nop_n", "nins_n", "nins_unknown", "adel_n"))


@query
def channel_events(spark, sf):
    return channel.with_events(_pairs(spark, sf)).select("q_id", F.size("events").cast("long").alias("n_events"), F.array_join(F.transform("events", lambda x: F.concat_ws("=", x["g"], x["event"])), ",").alias("events"))


# decoding


def _best(spark, sf):
    return context.top2(scored(spark, sf))


@query
def accept_threshold(spark, sf):
    return decode.accept(_best(spark, sf), 0.7, 0.1).select("q_id", "s1_id", *_round("p1", "p2"))


@query
def entity_guard(spark, sf):
    return decode.entity_guard(decode.accept(_best(spark, sf), 0.6), 0.97).select("q_id", "s1_id")


@query
def stage2_decision(spark, sf):
    return decode.decide(scored(spark, sf).withColumnRenamed("p", "r"), 0.85).select("q_id", *_round("r"))


@query
def expected_decode(spark, sf):
    return decode.expected_decode(scored(spark, sf).where("p >= 0.3").withColumnRenamed("p", "r"))


def _entities(spark, sf):
    return _t(spark, sf, "supplier").select(F.concat(F.lit("S1-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("pos"), F.col("s_nationkey").cast("string").alias("country"))


def _lists(spark, sf):
    return decode.assemble(_entities(spark, sf), decode.accept(_best(spark, sf), 0.95))


@query
def assemble_lists(spark, sf):
    return _lists(spark, sf).select("source1_entity_id", "matched_entity_ids", *_long("pos"))


@query
def candidate_lists(spark, sf):
    return decode.assemble(_entities(spark, sf), scored(spark, sf).where("p >= 0.9"), "candidate_entity_ids").select("source1_entity_id", "candidate_entity_ids")


def _order_truth(spark, sf):
    """An order's owner: the supplier of its first line, for orders not divisible by 4."""
    line = _t(spark, sf, "lineitem").where("l_linenumber = 1 and l_orderkey % 4 <> 0")
    q = F.concat(F.when(F.col("l_orderkey") % 2 == 0, F.lit("S2-")).otherwise(F.lit("S3-")), F.col("l_orderkey").cast("string"))
    return line.select(F.concat(F.lit("S1-"), F.col("l_suppkey").cast("string")).alias("s1"), q.alias("other")).distinct()


def _entity_scores(spark, sf):
    got = decode.accept(_best(spark, sf), 0.8).select(F.col("s1_id").alias("s1"), F.col("q_id").alias("other"))
    return decode.entity_scores(_entities(spark, sf).select(F.col("id").alias("s1"), "country"), _order_truth(spark, sf), got)


_METRICS = ("macro_f05", "singleton_f", "matched_f", "matched_precision", "predicted_share", "matched_recall")


@query
def macro_f05(spark, sf):
    return decode.macro_f05(_entity_scores(spark, sf)).select(*_long("entities"), *_round(*_METRICS))


@query
def macro_f05_by_country(spark, sf):
    return decode.macro_f05(_entity_scores(spark, sf), "country").select("country", *_long("entities"), *_round(*_METRICS))


_GRID = ([0.5, 0.7, 0.9], [0.0, 0.2])


@query
def threshold_grid(spark, sf):
    return decode.threshold_grid(_best(spark, sf), _order_truth(spark, sf), *_GRID).select("threshold", "gap", *_long("n_pred", "tp", "n_true"), *_round("precision", "recall", "f05"))


@query
def tuned_halves(spark, sf):
    e = _entities(spark, sf).select(F.col("id").alias("s1"))
    return decode.tuned(_best(spark, sf), e, _order_truth(spark, sf), [0.5, 0.7, 0.9], [0.0, 0.2], [0.0, 0.95]).select("threshold", "gap", "guard", *_long("half"), *_round("f05"))


@query
def reader_rows(spark, sf):
    return training.reader_rows(parties(spark, sf).select("id", F.coalesce("owner", "id").alias("grp"))).select("id")


@query
def best_threshold(spark, sf):
    return decode.best_threshold(decode.threshold_grid(_best(spark, sf), _order_truth(spark, sf), *_GRID)).select("threshold", "gap", *_round("f05"))


@query
def run_diagnostics(spark, sf):
    e = _entities(spark, sf).select(F.col("id").alias("s1_id"), "country")
    return decode.diagnostics(_best(spark, sf), e, 0.8).select("country", *_long("queries"), *_round("accepted", "sure", "empty_lists"))


@query
def validate_lists(spark, sf):
    """Lists with planted faults: rows missing, doubled, foreign, and wrong ids."""
    own = _lists(spark, sf).select("source1_entity_id", "matched_entity_ids", "pos")
    bad = own.where("pos % 10 <> 3").withColumn("matched_entity_ids", F.when(F.col("pos") % 7 == 0, F.lit("S2-1,S2-1,S1-5,X-2")).otherwise(F.col("matched_entity_ids")))
    bad = bad.unionByName(own.where("pos % 10 = 4")).unionByName(own.where("pos = 1").withColumn("source1_entity_id", F.lit("S1-none")))
    return decode.violations(bad, _entities(spark, sf)).distinct()


@query
def validate_lines(spark, sf):
    """A list file of the suppliers with planted faults, written as text and checked line by line; each line with its number."""
    own = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    key, tab = F.col("k").cast("string"), F.lit("\t")
    ids = F.when(F.col("k") % 7 == 0, F.lit("S2-1,S2-1,S1-5,X-2")).when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("S3-"), key, F.lit(",S2-"), key))
    row = F.concat(F.lit("S1-"), key, F.when(F.col("k") % 11 == 0, F.lit(" ")).otherwise(tab), ids)
    lines = own.where("k % 10 <> 3").select("k", row.alias("value")).unionByName(own.where("k % 10 = 4").select(F.col("k"), F.concat(F.lit("S1-"), key, tab).alias("value")))
    lines = lines.unionByName(own.where("k % 25 = 0").select("k", F.lit("").alias("value"))).unionByName(own.where("k = 1").select("k", F.lit("S1-none\tS2-9").alias("value")))
    at = shared_dir(spark)
    head = spark.createDataFrame([(-1, "source1_entity_id\tmatched_entity_ids")], "k long, value string")
    head.unionByName(lines).orderBy("k", "value").coalesce(1).select("value").write.text(at)
    known = own.where("k % 13 <> 0").select(F.concat(F.lit("S2-"), key).alias("id")).unionByName(own.select(F.concat(F.lit("S3-"), key).alias("id")))
    return rawcheck.violations(rawcheck.numbered_lines(spark, at), own.select(F.concat(F.lit("S1-"), key).alias("id")), known).select("rule", F.coalesce("line", F.lit(-1)).alias("line"), "id")


# training


@query
def group_folds(spark, sf):
    return training.group_folds(parties(spark, sf).select("id", F.coalesce("owner", "id").alias("grp"))).select("id", *_long("fold"))


@query
def exact_sample(spark, sf):
    return training.sample(parties(spark, sf).select("id"), "id", 100, 3)


@query
def world_split(spark, sf):
    p = parties(spark, sf)
    return training.world_split(p.where("role = 0").select("id", "country"), p.where("role > 0").select("id", "country", "owner"), 1.7)


@query
def training_halves(spark, sf):
    s = context.query_context(scored(spark, sf)).withColumn("true_s1", F.lit(None).cast("string"))
    return training.halves(s).select("q_id", "s1_id", *_long("half", "sub"))


#: Small trees, so that the query is quick to hold against others; the steps use training.MATCHER.
_FEW = boosting.Settings(rounds=12, leaves=15, rate=0.3, least_rows=20)


@query
def matcher_scores(spark, sf):
    """Trees on the training folds of party pairs, on all features, applied to the validation fold."""
    rows = stored(linkage.pair_table(*_sides(spark, sf), _truth(spark, sf), None, linkage.PlanConfig(top_k=5)).drop("true_s1"))
    model = training.fit_matcher(rows, feats.FeatureSpec.of(rows), _FEW)
    return training.predict(model, rows.where("fold = 0")).select("q_id", "s1_id", "label", F.round(F.col("p").cast("double"), 4).alias("p"))


def _stage2(spark, sf):
    return linkage.second_stage(stored(_party_scores(spark, sf)), *_sides(spark, sf))


@query
def stage2_context(spark, sf):
    """The columns of ``stage2_rows`` that SQL can express."""
    return _stage2(spark, sf).select("q_id", "s1_id", *_long("q_rank", "e_n", "e_strong", "e_same_src_strong", "sc_n", "sc_new", "q_addr_rdiv", "sib_addr_shared", "sib_name_shared", "num_inter", "v_unknown"))


@query
def stage2_rows(spark, sf):
    return _stage2(spark, sf).select("q_id", "s1_id", "q_rank", "e_n", "e_strong", "sc_n", "sib_addr_shared", F.size("events").alias("n_events"), F.round("n_ratio", 4).alias("n_ratio"))


@query
def stage2_model_rows(spark, sf):
    """Cross-fitted channel columns: order lines as pairs, halved and folded by their order; half 0 learns."""
    ev = _events(spark, sf).withColumns({"half": bucket(F.col("q_id"), 99, 2), "sub": bucket(F.col("q_id"), 5, 4)})
    got = channel.cross_fitted(ev, F.col("half") == 0).withColumns({"half": bucket(F.col("q_id"), 99, 2), "sub": bucket(F.col("q_id"), 5, 4)})
    each = [(f"{g}_{c}") for g in channel.GROUPS for c in ("sum", "min")]
    return got.select("q_id", "s1_id", *_long("half", "sub", *(f"{g}_{c}" for g in channel.GROUPS for c in ("n", "unknown"))), *_round(*each))


@query
def stage2_scores(spark, sf):
    """The second stage of party pairs: learnt on half of the entities, the scores of the other half's pairs."""
    rows = stored(rerank.with_channel(rerank.labelled(stored(_stage2(spark, sf)), _truth(spark, sf))))
    model = training.fit_matcher(rows.where("half = 0"), rerank.spec_of(rows), _FEW, held=f"sub = {rerank.HELD}")
    return model.transform(rows.where("half = 1"), "r").select("q_id", "s1_id", "label", F.round("r", 4).alias("r"))


@query
def event_windows(spark, sf):
    from tessera.streaming.stream import event_counts

    return event_counts(_t(spark, sf, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", *_long("n"), F.round("total", 4).alias("total"))


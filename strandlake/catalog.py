"""All queries of the library outside its optional subpackages, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.stats import adjusted, t_summary, wilson
from strandlake.operators import draws, intervals, matching, pairs, ranking, regions, regression, resampling
from strandlake.plans import evolution, files, matrices, models, oracles, quantiles, sql, windows
from strandlake.plans.base import hours, sites, table

_KEYS = ["entity", "mark"]


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(sites(spark, sf_dir), _KEYS, "pos", 24, 3)


def consensus_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.consensus(sites(spark, sf_dir), _KEYS, "pos", (12, 18, 24), 24, 3)


def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.close_pairs(sites(spark, sf_dir), _KEYS, "pos", 10)


def per_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sites(spark, sf_dir)
    return pairs.effects(found, found, "entity", "mark", "pos", 10)


def wilson_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = per_protein(spark, sf_dir).groupBy("mark").agg(F.count_if(F.col("effect") > 0).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return made.select("mark", "k", "n", F.round(low, 9).alias("ci_low"), F.round(high, 9).alias("ci_high"))


def exact_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean effect over its exact standard error under sampling, for each mark."""
    z = F.avg("effect") / F.nullif(F.sqrt(F.sum("null_variance")) / F.count("*"), F.lit(0.0))
    return per_protein(spark, sf_dir).groupBy("mark").agg(F.count("*").alias("n"), F.round(z, 5).alias("z"))


def holm_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), (F.pmod(F.col("p_partkey") * 7919, F.lit(10007)) / F.lit(10007.0)).alias("p"))
    return adjusted(p, "p", "id", ["family"]).select("id", F.round("holm", 9).alias("holm"), F.round("bh", 9).alias("bh"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).alias("score"))
    return docs.join(table(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id")


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.auroc(_scored(spark, sf_dir), "quality", "score")


def auroc_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.auroc(_scored(spark, sf_dir), "quality", "score", ["lang"])


def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.average_precision(_scored(spark, sf_dir), "quality", "score")


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.roc_points(_scored(spark, sf_dir), "quality", "score")


_COVARIATES = ["balance", "closed", "orders", "spent"]


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers of one segment as cases (highest balance first) and all others as donors, with four covariates in deviations, rounded so that any engine has the same."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("spent"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("closed"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").cast("double").alias("balance"), (F.col("c_mktsegment") == "BUILDING").alias("is_case")).join(spent, "id", "left").fillna(0, ["orders", "spent", "closed"])
    made = matching.standardised(rows, _COVARIATES, ["orders", "spent"]).withColumns({c: F.round(c, 6) for c in _COVARIATES})
    return made.where("is_case").withColumn("rank", F.struct((-F.col("balance")).alias("low"), "id")), made.where("NOT is_case")


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's donors within half a deviation in all four covariates."""
    made = matching.in_reach(*_customers(spark, sf_dir), _COVARIATES, 0.5)
    return made.groupBy(F.col("case").alias("case_id")).agg(F.count("*").alias("candidates"), F.round(F.min("distance"), 9).alias("nearest"))


def caliper_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's three nearest donors within half a deviation in all four covariates that cases before it have left."""
    cases, donors = _customers(spark, sf_dir)
    made = matching.serve_near(spark, cases, donors, _COVARIATES, most=3, reach=0.5)
    return made.select(F.col("case").alias("case_id"), F.col("donor").alias("control"), F.round("distance", 9).alias("distance"))


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's nearest free donor, however far, by balance and orders."""
    made = matching.greedy_match(spark, *_customers(spark, sf_dir), ["balance", "orders"])
    return made.select(F.col("case").alias("case_id"), F.col("donor").alias("control"), F.round("distance", 9).alias("distance"))


def _rounded(made: DataFrame) -> DataFrame:
    return made.withColumns({"estimate": F.round("estimate", 9), "ci_low": F.round("ci_low", 6), "ci_high": F.round("ci_high", 6)})


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over users of their mean value, users redrawn."""
    return _rounded(draws.mean(table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("v")), "user_id", "v"))


def fold_ratio_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focal mark's ratio of observed to expected close pairs over each other mark's, entities with both redrawn together."""
    made = per_protein(spark, sf_dir).select("entity", "mark", "observed", "expected")
    focal = made.where("mark = 'purchase'").select("entity", F.col("observed").alias("own"), F.col("expected").alias("own_null"))
    both = made.where("mark <> 'purchase'").withColumnRenamed("mark", "control").join(focal, "entity")
    return _rounded(draws.double_ratio(both, "entity", ("own", "own_null"), ("observed", "expected"), by="control"))


def fold_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mark's ratio of observed to expected close pairs, entities redrawn."""
    return _rounded(draws.ratio(per_protein(spark, sf_dir), "entity", "observed", "expected", by="mark"))


def auroc_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area under the ROC curve, sources of documents redrawn whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("score"), F.floor(F.col("doc_id") / 8).alias("cluster"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return _rounded(draws.auroc(rows, "cluster", "quality", "score"))


def stratified_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close pairs of the focal mark against 2000 draws that keep how many of its sites are under each set of islands."""
    made = draws.stratified_null(_strata(spark, sf_dir), "entity", "pos", "signature", "focal")
    return made.withColumns({c: F.round(c, 9) for c in ("observed", "null_mean", "effect", "p")} | {"null_sd": F.round("null_sd", 7), "fold": F.round("fold", 7)})


def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.concat_ws("|", F.lit("analysis"), F.col("c_name"))
    seed = F.pmod(F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") + 42, F.lit(1 << 32))
    return table(spark, sf_dir, "customer").select("c_custkey", seed.alias("seed"))


def md5_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(5))
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", fold.alias("fold"))


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


def spatial_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label whose first three coordinates are near: cells of the radius's width, each joined with the 27 around it."""
    radius = 0.02
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))
    cell = [F.floor(F.col(c) / radius).cast("long") for c in "xyz"]
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    a = points.select("*", *(c.alias(f"c{i}") for i, c in enumerate(cell)))
    b = points.select("*", *(c.alias(f"d{i}") for i, c in enumerate(cell)))
    for i in range(3):
        b = b.withColumn(f"s{i}", F.explode(near)).withColumn(f"c{i}", F.col(f"d{i}") + F.col(f"s{i}"))
    b = b.select("label", "c0", "c1", "c2", *(F.col(c).alias(f"{c}2") for c in ("vec_id", "x", "y", "z")))
    close = a.join(b, ["label", "c0", "c1", "c2"]).where("vec_id < vec_id2 AND (x - x2) * (x - x2) + (y - y2) * (y - y2) + (z - z2) * (z - z2) <= 0.0004D")
    return close.groupBy("label").agg(F.count("*").alias("n"))


def null_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity and mark: mean and deviation of the close pairs under sampling, in pairs."""
    made = per_protein(spark, sf_dir)
    possible = F.col("n_sites") * (F.col("n_sites") - 1) / 2
    return made.select("entity", "mark", F.round(F.col("expected") * possible, 4).alias("mean"), F.round(F.sqrt("null_variance") * possible, 3).alias("sd"))


def list_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sites(spark, sf_dir).groupBy(*_KEYS).agg(F.array_join(F.array_sort(F.collect_list("pos")), ";").alias("positions"))
    numbers = F.transform(F.split("positions", ";"), lambda x: x.cast("long"))
    return coded.select(*_KEYS, "positions", F.size(numbers).cast("long").alias("n"), F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, pos, focal, signature): coordinates with any mark, whether the focal one is there, and the islands that cover them."""
    found = sites(spark, sf_dir)
    spans = intervals.islands(found, _KEYS, "pos", 24, 3).select("entity", F.col("mark").alias("span_mark"), "start", "end")
    pool = found.groupBy("entity", "pos").agg(F.max((F.col("mark") == "purchase").cast("int")).alias("focal"))
    # Spans and coordinates meet in buckets of 64, not by entity alone.
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor(F.col("end") / 64))))
    covered = pool.withColumn("bucket", F.floor(F.col("pos") / 64)).join(spans, ["entity", "bucket"]).where(F.col("pos").between(F.col("start"), F.col("end"))).select("entity", "pos", F.concat_ws(":", "span_mark", F.col("start").cast("string")).alias("span"))
    signature = covered.groupBy("entity", "pos").agg(F.array_join(F.array_sort(F.collect_set("span")), "|").alias("signature"))
    return pool.join(signature, ["entity", "pos"], "left").withColumn("signature", F.coalesce("signature", F.lit("uncovered")))


def exposure_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of an entity by the islands that cover them: how many are eligible, and how many have the focal mark."""
    return _strata(spark, sf_dir).groupBy("entity", "signature").agg(F.count("*").alias("n_eligible"), F.sum("focal").cast("long").alias("n_observed"))


def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the next: Pearson (null without variance), cosine, and 1 - Jensen-Shannon of the components' sizes."""
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.col("x").cast("double").alias("x"))
    flat = flat.join(flat.groupBy("vec_id").agg(F.sum(F.abs("x")).alias("t")), "vec_id").withColumn("p", F.try_divide(F.abs("x"), F.col("t")))
    other = flat.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("x").alias("y"), F.col("p").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    both = flat.join(other, ["vec_id", "i"])
    return both.groupBy("vec_id").agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))), 6).alias("cosine"), F.round(1 - F.sum(part("p") + part("q")) / 2, 6).alias("js"))


def ols_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.ols_clustered(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey")


def logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _scored(spark, sf_dir).withColumn("log_score", F.log10(F.col("score") + 1))
    return regression.logit(made, "quality", ["log_score"])


def hypergeom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper tail for labels of both kinds together; four counts go to the driver."""
    both = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    r = both.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("toxic") == 1).alias("b"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("k")).first()
    return spark.createDataFrame([(r["k"], r["n"], r["a"], r["b"], round(resampling.hypergeometric_tail(r["k"], r["n"], r["a"], r["b"]), 9))], "k long, population long, marked long, drawn long, p double")


def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the focal mark's effects are apart from 0, entities' signs flipped."""
    made = draws.sign_flip(per_protein(spark, sf_dir).where("mark = 'purchase'"), "entity", "effect")
    return made.select("n", F.round("mean", 9).alias("mean"), F.round("p", 9).alias("p"))


def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over events, users redrawn with all of theirs."""
    return _rounded(draws.mean(table(spark, sf_dir, "events"), "user_id", "value"))


def publication_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each island's sites with evidence buckets of their own."""
    found = hours(table(spark, sf_dir, "events")).select("entity", "mark", "pos", F.floor(F.col("value") / 50).cast("long").alias("source"))
    spans = islands(spark, sf_dir).select("entity", "mark", "start", "end").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor(F.col("end") / 64))))
    inside = found.withColumn("bucket", F.floor(F.col("pos") / 64)).join(spans, [*_KEYS, "bucket"]).where(F.col("pos").between(F.col("start"), F.col("end")))
    return matching.maximum_matching(inside, ["entity", "mark", "start"], "pos", "source")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of the focal mark, whose sources are ranges of event values."""
    found = hours(table(spark, sf_dir, "events")).where("mark = 'purchase'").select("entity", "pos", F.floor(F.col("value") / 50).cast("long").alias("source"))
    return regions.materialised(found, ["entity"], "pos", "source", 24, 3)


def region_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's positions and sources, and whether it stands without any one source."""
    return _regions(spark, sf_dir).select("entity", "start", "end", "span", "valence", "positions", "n_sources", "sources", "survives", F.concat_ws(":", F.lit("v1"), "entity", F.concat_ws("-", "start", "end")).alias("region_id"))


def region_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's sites with their sources."""
    made = _regions(spark, sf_dir).select("entity", "start", F.explode("members").alias("m"))
    return made.select("entity", "start", F.col("m.pos").alias("pos"), F.size("m.sources").cast("long").alias("n_sources"), F.array_join("m.sources", ";").alias("sources"))


def t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mark: the mean effect, its interval, and the one-sided p with its corrections over marks."""
    made = t_summary(per_protein(spark, sf_dir), "effect", ["mark"]).withColumn("family", F.lit(1))
    return adjusted(made, "p", "mark", ["family"]).select("mark", "n", *(F.round(c, 6).alias(c) for c in ("mean", "se", "t", "ci_low", "ci_high")), *(F.round(F.log10(c), 5).alias(f"log10_{c}") for c in ("p", "holm", "bh")))


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched differences of the focal mark from each other one, with corrected one-sided p values."""
    made = per_protein(spark, sf_dir).select("entity", "mark", "effect")
    focal = made.where("mark = 'purchase'").select("entity", F.col("effect").alias("own"))
    pairs_ = made.where("mark <> 'purchase'").join(focal, "entity").select(F.col("mark").alias("control"), (F.col("own") - F.col("effect")).alias("difference"))
    tested = t_summary(pairs_, "difference", ["control"]).withColumn("family", F.lit(1))
    return adjusted(tested, "p", "control", ["family"]).select("control", "n", F.round("mean", 6).alias("mean_difference"), F.round("p", 9).alias("p"), F.round("holm", 9).alias("holm"), F.round("bh", 9).alias("bh"))


_CTES = {k: sql.duck_query(v) for k, v in {"sites": sql._SITES, "chain": sql._CHAIN, "eff": sql._FRACTIONS, "scored": sql._SCORED}.items()}
_EFFECTS = f"""WITH {_CTES['sites']}, near AS (SELECT entity, mark, count(*) OVER (PARTITION BY entity, mark ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - 1 AS d FROM sites),
s AS (SELECT entity, mark, count(*)::DOUBLE AS k, floor(sum(d) / 2) AS edges FROM near GROUP BY ALL HAVING count(*) >= 3),
pool AS (SELECT DISTINCT entity, pos FROM sites), pn AS (SELECT entity, count(*) OVER (PARTITION BY entity ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - 1 AS d FROM pool),
u AS (SELECT entity, count(*)::DOUBLE AS n, floor(sum(d) / 2) AS e, floor(sum(d * (d - 1)) / 2) AS adj FROM pn GROUP BY ALL),
j AS (SELECT s.entity, mark, k, n, edges, e, adj, k * (k - 1) / 2 AS possible, coalesce(k * (k - 1) / nullif(n * (n - 1), 0), 0) AS p2, coalesce(k * (k - 1) * (k - 2) / nullif(n * (n - 1) * (n - 2), 0), 0) AS p3, coalesce(k * (k - 1) * (k - 2) * (k - 3) / nullif(n * (n - 1) * (n - 2) * (n - 3), 0), 0) AS p4 FROM s JOIN u ON s.entity = u.entity),
eff AS (SELECT entity, mark, 10 AS radius, k::BIGINT AS n_sites, n::BIGINT AS n_eligible, edges::BIGINT AS observed_pairs, round(edges / possible, 9) AS observed, round(e * p2 / possible, 9) AS expected, round(edges / possible - e * p2 / possible, 9) AS effect,
round(greatest(e * p2 + 2 * adj * p3 + 2 * (e * (e - 1) / 2 - adj) * p4 - e * p2 * e * p2, 0) / (possible * possible), 9) AS null_variance FROM j)"""
_STEPS = f"WITH {_CTES['scored']}, ranked AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY lang_key, score) - 1) / 2.0 AS r FROM (SELECT *, {{key}} AS lang_key FROM scored) t WINDOW w AS (PARTITION BY lang_key ORDER BY score))"
_AUROC = "sum(label)::BIGINT AS positives, (count(*) - sum(label))::BIGINT AS negatives, round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 9) AS auroc FROM ranked"

_DRAWN = "(SELECT k.*, draw, {base} AS start FROM k CROSS JOIN (SELECT unnest(range(1, {draws} + 1)) AS draw))"
_REDRAWN = draws.numbers_sql(_DRAWN.format(base=draws.base_sql(42, "key"), draws=1000), "start", "draw") + " w"


def _interval_sql(keys: str, estimate: str, values: tuple[str, ...], by: str | None = None) -> str:
    """keys: (key, g, values). Every key is drawn anew in each of 1000 draws, as often as its stream says."""
    times = draws.poisson_sql("u")
    of = ", ".join
    return (
        f"WITH k AS ({keys}), e AS (SELECT g, {estimate} AS e FROM (SELECT g, draw, {of(f'sum({v} * ({times})) AS {v}' for v in values)} FROM {_REDRAWN} GROUP BY g, draw)), "
        f"o AS (SELECT g, n, {estimate} AS estimate FROM (SELECT g, count(DISTINCT key) AS n, {of(f'sum({v}) AS {v}' for v in values)} FROM k GROUP BY g)), "
        "b AS (SELECT g, quantile_cont(e, 0.025) AS l, quantile_cont(e, 0.975) AS h FROM e WHERE e IS NOT NULL GROUP BY g) "
        f"SELECT {f'o.g AS {by}, ' if by else ''}n, round(estimate, 9) AS estimate, round(l, 6) AS ci_low, round(h, 6) AS ci_high FROM o LEFT JOIN b USING (g)"
    )


_MEMBERS = f"""WITH {_CTES['sites']}, fl AS (SELECT entity, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY entity ORDER BY pos) <= 24 THEN 0 ELSE 1 END AS f FROM sites WHERE mark = 'purchase'), nu AS (SELECT entity, pos, sum(f) OVER (PARTITION BY entity ORDER BY pos) AS k FROM fl), big AS (SELECT entity, k FROM nu GROUP BY entity, k HAVING count(*) >= 3),
member AS (SELECT DISTINCT n.entity, n.k, n.pos, CAST(floor(h.value / 50) AS BIGINT) AS src FROM nu n JOIN big USING (entity, k) JOIN {sql.DUCK_HOURS} h ON h.entity = n.entity AND h.pos = n.pos AND h.mark = 'purchase')"""
_PEOPLE = (
    "WITH RECURSIVE spent AS (SELECT o_custkey AS id, count(*) AS orders, sum(o_totalprice::DECIMAL(20, 2))::DOUBLE AS spent, avg((o_orderstatus = 'F')::INTEGER) AS closed FROM orders GROUP BY o_custkey), "
    "raw AS (SELECT c_custkey::BIGINT AS id, c_acctbal::DOUBLE AS balance, c_mktsegment = 'BUILDING' AS is_case, log10(coalesce(orders, 0)::DOUBLE + 1) AS orders, log10(coalesce(spent, 0) + 1) AS spent, coalesce(closed, 0) AS closed FROM customer LEFT JOIN spent ON spent.id = c_custkey), "
    f"z AS (SELECT id, is_case, {', '.join(f'round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}' for c in _COVARIATES)} FROM raw)"
)
_SQUARES = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _COVARIATES)
_BOX = " AND ".join(f"abs(a.{c} - b.{c}) <= 0.5" for c in _COVARIATES)


def _served(on: str, squares: str, most: int) -> str:
    """Cases one by one: a round of the recursion serves one and carries the donors that are taken."""
    return (
        f"{_PEOPLE}, pair AS MATERIALIZED (SELECT a.i, a.id AS case_id, b.id AS donor, {squares} AS d, {draws.base_sql(42, 'b.id')} AS tie FROM (SELECT *, row_number() OVER (ORDER BY -balance, id) AS i FROM z WHERE is_case) a JOIN z b ON {on}), "
        f"step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS got, []::BIGINT[] AS used UNION ALL SELECT i + 1, got, list_concat(used, got) FROM (SELECT s.i, s.used, coalesce((SELECT list(p.donor ORDER BY p.d, p.tie, p.donor) FROM pair p WHERE p.i = s.i + 1 AND NOT list_contains(s.used, p.donor)), [])[1:{most}] AS got FROM step s WHERE s.i < (SELECT count(*) FROM z WHERE is_case))) "
        "SELECT p.case_id, p.donor AS control, round(p.d, 9) AS distance FROM (SELECT i, unnest(got) AS donor FROM step) g JOIN pair p ON p.i = g.i AND p.donor = g.donor"
    )


_AUROC_CI = (
    f"WITH k AS (SELECT (d.doc_id // 8)::VARCHAR AS key, quality AS y, length(text) AS s FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL), w AS (SELECT draw, y, s, {draws.poisson_sql('u')} AS w FROM {_REDRAWN} UNION ALL SELECT 0, y, s, 1 FROM k), "
    "t AS (SELECT draw, s, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM w GROUP BY draw, s), c AS (SELECT draw, p, n, sum(n) OVER (PARTITION BY draw ORDER BY s) - n / 2.0 AS below FROM t), e AS (SELECT draw, sum(p * below) / nullif(sum(p) * sum(n), 0) AS e FROM c GROUP BY draw) "
    "SELECT (SELECT count(DISTINCT key) FROM k) AS n, round(max(e) FILTER (WHERE draw = 0), 9) AS estimate, round(quantile_cont(e, 0.025) FILTER (WHERE draw > 0), 6) AS ci_low, round(quantile_cont(e, 0.975) FILTER (WHERE draw > 0), 6) AS ci_high FROM e"
)
_SIGNED = f"""WITH {_CTES['chain']}, pool AS (SELECT entity, pos, max(CASE WHEN mark = 'purchase' THEN 1 ELSE 0 END) AS focal FROM sites GROUP BY ALL), sig AS (SELECT p.entity, p.pos, any_value(focal) AS focal, coalesce(string_agg(i.mark || ':' || i.s, '|' ORDER BY i.mark || ':' || i.s), 'uncovered') AS signature FROM pool p LEFT JOIN islands i ON p.entity = i.entity AND p.pos BETWEEN i.s AND i.e GROUP BY p.entity, p.pos)"""
_RADII = (5, 10, 15, 20, 25, 30)
_NEAR = ", ".join(f"sum(n{r}) AS n{r}" for r in _RADII)
_COUNT = ", ".join(f"count(*) OVER (o RANGE BETWEEN CURRENT ROW AND {r} FOLLOWING) - 1 AS n{r}" for r in _RADII)
# Draws by ranks within each stratum; the rows as they are make draw 0.
_STRATIFIED = _SIGNED + f""", k AS (SELECT *, sum(focal) OVER s AS k, count(*) OVER s AS size FROM sig WINDOW s AS (PARTITION BY entity, signature)),
n AS (SELECT entity, sum(focal)::BIGINT AS n_sites, count(DISTINCT signature) FILTER (WHERE k > 0) AS n_strata, (sum(focal) FILTER (WHERE k < size))::BIGINT AS n_variable FROM k GROUP BY entity HAVING sum(focal) >= 2),
r AS (SELECT entity, pos, draw, k, row_number() OVER (PARTITION BY entity, signature, draw ORDER BY number) AS r FROM {draws.numbers_sql(_DRAWN.format(base=draws.base_sql(42, "entity || ':' || pos"), draws=2000), "start", "draw")} x WHERE k > 0 AND entity IN (SELECT entity FROM n)),
p AS (SELECT entity, draw, pos FROM r WHERE r <= k UNION ALL SELECT entity, 0, pos FROM sig WHERE focal = 1 AND entity IN (SELECT entity FROM n)),
c AS (SELECT entity, draw, {_NEAR} FROM (SELECT entity, draw, {_COUNT} FROM p WINDOW o AS (PARTITION BY entity, draw ORDER BY pos)) GROUP BY entity, draw),
u AS (SELECT entity, draw, radius, pairs FROM (SELECT entity, draw, unnest([{', '.join(map(str, _RADII))}]) AS radius, unnest([{', '.join(f'n{r}' for r in _RADII)}]) AS pairs FROM c)),
f AS (SELECT u.entity, u.radius, any_value(o.pairs)::BIGINT AS observed_pairs, avg(u.pairs) AS m, stddev_samp(u.pairs) AS sd, count(*) FILTER (WHERE u.pairs >= o.pairs) AS as_many FROM u JOIN u o ON o.entity = u.entity AND o.radius = u.radius AND o.draw = 0 WHERE u.draw > 0 GROUP BY u.entity, u.radius),
g AS (SELECT *, n_sites * (n_sites - 1) // 2 AS possible_pairs, observed_pairs / (n_sites * (n_sites - 1) / 2) AS observed, m / (n_sites * (n_sites - 1) / 2) AS null_mean FROM f JOIN n USING (entity))
SELECT entity, radius, n_sites, n_strata, coalesce(n_variable, 0) AS n_variable, observed_pairs, possible_pairs, round(observed, 9) AS observed, round(null_mean, 9) AS null_mean, round(sd / possible_pairs, 7) AS null_sd, round(CASE WHEN abs(observed - null_mean) < 1e-12 THEN 0 ELSE observed - null_mean END, 9) AS effect, round(observed / nullif(null_mean, 0), 7) AS fold, round((as_many + 1) / 2001.0, 9) AS p FROM g"""

#: Operators written with DataFrames, each with SQL of its own.
_OWN: dict[Callable, str | None] = {
    islands: f"WITH {_CTES['chain']} SELECT entity, mark, s AS start, e AS \"end\", n AS valence FROM islands",
    consensus_regions: f"""WITH {_CTES['sites']}, f1 AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY entity, mark ORDER BY pos) <= 12 THEN 0 ELSE 1 END AS f FROM sites), k1 AS (SELECT *, sum(f) OVER (PARTITION BY entity, mark ORDER BY pos) AS k FROM f1),
c AS (SELECT entity, mark, pos FROM (SELECT *, count(*) OVER (PARTITION BY entity, mark, k) AS n FROM k1) t WHERE n >= 3), f2 AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY entity, mark ORDER BY pos) <= 24 THEN 0 ELSE 1 END AS f FROM c), k2 AS (SELECT *, sum(f) OVER (PARTITION BY entity, mark ORDER BY pos) AS k FROM f2)
SELECT entity, mark, min(pos) AS start, max(pos) AS "end", count(*) AS valence FROM k2 GROUP BY entity, mark, k HAVING count(*) >= 3""",
    close_pairs: f"WITH {_CTES['sites']}, d AS (SELECT a.entity, a.mark, a.pos, count(*) - 1 AS d FROM sites a JOIN sites b ON a.entity = b.entity AND a.mark = b.mark AND b.pos BETWEEN a.pos - 10 AND a.pos + 10 GROUP BY ALL) SELECT entity, mark, count(*) AS n, (sum(d) / 2)::BIGINT AS edges, (sum(d * (d - 1)) / 2)::BIGINT AS adjacent FROM d GROUP BY ALL",
    per_protein: _EFFECTS + " SELECT * FROM eff",
    wilson_breadth: _EFFECTS + ", c AS (SELECT mark, count(*) FILTER (WHERE effect > 0) AS k, count(*) AS n FROM eff GROUP BY mark) SELECT mark, k, n, round((k / n + 1.959963984540054^2 / (2 * n)) / (1 + 1.959963984540054^2 / n) - 1.959963984540054 / (1 + 1.959963984540054^2 / n) * sqrt(k / n * (1 - k / n) / n + 1.959963984540054^2 / (4 * n * n)), 9) AS ci_low, round((k / n + 1.959963984540054^2 / (2 * n)) / (1 + 1.959963984540054^2 / n) + 1.959963984540054 / (1 + 1.959963984540054^2 / n) * sqrt(k / n * (1 - k / n) / n + 1.959963984540054^2 / (4 * n * n)), 9) AS ci_high FROM c",
    exact_z: _EFFECTS + " SELECT mark, count(*) AS n, round(avg(effect) / nullif(sqrt(sum(null_variance)) / count(*), 0), 5) AS z FROM eff GROUP BY mark",
    holm_bh: "WITH t AS (SELECT p_partkey AS id, p_brand AS family, (p_partkey * 7919 % 10007) / 10007.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS i, count(*) OVER (PARTITION BY family) AS m FROM t) SELECT id, round(least(max(p * (m - i + 1)) OVER (PARTITION BY family ORDER BY i), 1), 9) AS holm, round(least(min(p * m / i) OVER (PARTITION BY family ORDER BY i DESC), 1), 9) AS bh FROM r",
    auroc: _STEPS.format(key="1") + f" SELECT {_AUROC}",
    auroc_by_entity: _STEPS.format(key="lang") + f" SELECT lang, {_AUROC} GROUP BY lang HAVING sum(label) > 0 AND sum(label) < count(*)",
    avg_precision: f"WITH {_CTES['scored']}, s AS (SELECT score, sum(label) AS p, count(*) AS n FROM scored GROUP BY score), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM s) SELECT round(sum(p * tp / seen) / sum(p), 9) AS ap FROM c",
    roc_points: f"WITH {_CTES['scored']}, s AS (SELECT score, sum(label) AS p, count(*) AS n FROM scored GROUP BY score), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n - p) OVER (ORDER BY score DESC) AS fp FROM s) SELECT score, round(tp / (SELECT sum(p) FROM s), 9) AS tpr, round(fp / (SELECT sum(n - p) FROM s), 9) AS fpr FROM c",
    null_moments: _EFFECTS + " SELECT entity, mark, round(expected * n_sites * (n_sites - 1) / 2, 4) AS mean, round(sqrt(null_variance) * n_sites * (n_sites - 1) / 2, 3) AS sd FROM eff",
    list_codec: f"WITH {_CTES['sites']} SELECT entity, mark, string_agg(pos::VARCHAR, ';' ORDER BY pos) AS positions, count(*) AS n, sum(pos)::BIGINT AS total FROM sites GROUP BY entity, mark",
    exposure_strata: _SIGNED + """
SELECT entity, signature, count(*) AS n_eligible, sum(focal)::BIGINT AS n_observed FROM sig GROUP BY entity, signature""",
    vector_similarity: "WITH f AS (SELECT vec_id, i, x::DOUBLE AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) t), p AS (SELECT *, abs(x) / nullif(sum(abs(x)) OVER (PARTITION BY vec_id), 0) AS p FROM f), j AS (SELECT a.vec_id, a.x, b.x AS y, a.p, b.p AS q, (a.p + b.p) / 2 AS m FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND a.i = b.i) SELECT vec_id, round(corr(x, y), 6) AS pearson, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine, round(1 - sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 6) AS js FROM j GROUP BY vec_id",
    t_interval: None,
    contrasts: None,
    ols_cluster: None,
    logit: None,
    hypergeom: "WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS a, count(*) FILTER (WHERE toxic = 1) AS b, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS k FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT *, unnest(range(greatest(k, a + b - n), least(a, b) + 1)) AS i FROM c), choose AS (SELECT i, lgamma(a + 1) - lgamma(i + 1) - lgamma(a - i + 1) + lgamma(n - a + 1) - lgamma(b - i + 1) - lgamma(n - a - b + i + 1) - lgamma(n + 1) + lgamma(b + 1) + lgamma(n - b + 1) AS l FROM t) SELECT k, n AS population, a AS marked, b AS drawn, round(least(1, (SELECT sum(exp(l)) FROM choose)), 9) AS p FROM c",
    sign_flip: _EFFECTS + f", k AS (SELECT entity::VARCHAR AS key, effect AS v FROM eff WHERE mark = 'purchase'), m AS (SELECT draw, sum(CASE WHEN u < 0.5 THEN -v ELSE v END) AS t FROM {_REDRAWN} GROUP BY draw), o AS (SELECT count(*) AS n, sum(v) AS t FROM k) SELECT any_value(n) AS n, round(any_value(o.t) / any_value(n), 9) AS mean, round((1 + count(*) FILTER (WHERE abs(m.t) >= abs(o.t) - 1e-9)) / 1001.0, 9) AS p FROM m CROSS JOIN o",
    cluster_bootstrap: _interval_sql("SELECT user_id::VARCHAR AS key, '' AS g, sum(value) AS a, count(*) AS b FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id", "a / nullif(b, 0)", ("a", "b")),
    fold_ci: _EFFECTS + ", " + _interval_sql("SELECT entity::VARCHAR AS key, mark AS g, observed AS a, expected AS b FROM eff", "a / nullif(b, 0)", ("a", "b"), "mark").removeprefix("WITH "),
    fold_ratio_ci: _EFFECTS + ", " + _interval_sql("SELECT f.entity::VARCHAR AS key, c.mark AS g, f.observed AS a, f.expected AS b, c.observed AS c, c.expected AS d FROM eff f JOIN eff c ON f.entity = c.entity WHERE f.mark = 'purchase' AND c.mark <> 'purchase'", "(a / nullif(b, 0)) / nullif(c / nullif(d, 0), 0)", ("a", "b", "c", "d"), "control").removeprefix("WITH "),
    auroc_ci: _AUROC_CI,
    stratified_null: _STRATIFIED,
    publication_matching: None,
    region_members: _MEMBERS + """, gone AS (SELECT DISTINCT entity, k, src FROM member), kept AS (SELECT DISTINCT g.entity, g.k, g.src AS removed, m.pos FROM gone g JOIN member m ON m.entity = g.entity AND m.k = g.k AND m.src <> g.src),
kf AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY entity, k, removed ORDER BY pos) <= 24 THEN 0 ELSE 1 END AS f FROM kept), kn AS (SELECT *, sum(f) OVER (PARTITION BY entity, k, removed ORDER BY pos) AS c FROM kf), kl AS (SELECT entity, k, removed FROM kn GROUP BY entity, k, removed, c HAVING count(*) >= 3),
s AS (SELECT g.entity, g.k, count(DISTINCT g.src) = count(DISTINCT l.removed) AS survives FROM gone g LEFT JOIN kl l ON l.entity = g.entity AND l.k = g.k AND l.removed = g.src GROUP BY g.entity, g.k)
SELECT m.entity, min(pos) AS start, max(pos) AS "end", max(pos) - min(pos) + 1 AS span, count(DISTINCT pos) AS valence, array_to_string(list_sort(list(DISTINCT pos)), ';') AS positions, count(DISTINCT src) AS n_sources, string_agg(DISTINCT src::VARCHAR, ';' ORDER BY src::VARCHAR) AS sources, coalesce(any_value(s.survives), false) AS survives, 'v1:' || m.entity || ':' || min(pos) || '-' || max(pos) AS region_id FROM member m LEFT JOIN s ON s.entity = m.entity AND s.k = m.k GROUP BY m.entity, m.k""",
    region_sites: _MEMBERS + """ SELECT entity, start, pos, count(src) AS n_sources, coalesce(string_agg(src::VARCHAR, ';' ORDER BY src::VARCHAR), '') AS sources FROM (SELECT *, min(pos) OVER (PARTITION BY entity, k) AS start FROM member) t GROUP BY entity, start, pos""",
    match_candidates: _PEOPLE + f" SELECT a.id AS case_id, count(*) AS candidates, round(min({_SQUARES}), 9) AS nearest FROM z a JOIN z b ON a.is_case AND NOT b.is_case AND {_BOX} GROUP BY a.id",
    caliper_match: _served(f"a.is_case AND NOT b.is_case AND {_BOX}", _SQUARES, 3),
    greedy_match: _served("a.is_case AND NOT b.is_case", "(a.balance - b.balance) * (a.balance - b.balance) + (a.orders - b.orders) * (a.orders - b.orders)", 1),
    bootstrap_ci: _interval_sql("SELECT user_id::VARCHAR AS key, '' AS g, avg(value) AS a, 1 AS b FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING avg(value) IS NOT NULL", "a / nullif(b, 0)", ("a", "b")),
    spatial_contacts: "WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) SELECT a.label, count(*) AS n FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0004 GROUP BY a.label",
    stable_seed: "SELECT c_custkey, (('0x' || substr(sha256('analysis|' || c_name), 1, 8))::BIGINT + 42) % 4294967296 AS seed FROM customer",
    md5_folds: "SELECT DISTINCT user_id, ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM events",
    content_digest: "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents",
    windows.tiles: "WITH t AS (SELECT doc_id, substr(text, c - 25, 51) AS w FROM (SELECT doc_id, text, unnest(range(26, length(text) - 24, 10)) AS c FROM documents WHERE length(text) >= 51) z) SELECT doc_id, count(*) AS tiles, round(sum((102 - length(replace(w, 's', '')) - length(replace(w, 't', ''))) / 51e0), 6) AS st_sum FROM t GROUP BY doc_id",
}


_OWN |= evolution.QUERIES | files.QUERIES | matrices.QUERIES | models.QUERIES | windows.BY_LIST
_OWN |= {f: sql.duck_query(sql.SHARED.pop(f.__name__)) for f in (*windows.BY_CHARACTER, *quantiles.BY_BUFFER)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OWN} | {k: sql.spark_query(sql.SPARK.get(k, v)) for k, v in sql.SHARED.items()}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: v for f, v in _OWN.items() if v} | {k: sql.duck_query(oracles.PLAIN.get(k, v)) for k, v in sql.SHARED.items()}

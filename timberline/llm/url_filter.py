"""URL filter: a tree of path templates per host, and the labelled purity of each template."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import saved, small

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Pages that a node needs to be split, and a branch to be told from its siblings, and how many standard deviations its labels must differ.
SUPPORT, APART = 20, 3.0
#: Weight of the rate above in a smoothed rate, and the purity below which a template is rejected.
PRIOR, PURE = 8.0, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def segments(path: Column) -> Column:
    """The path's segments with what varies made a wildcard."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9a-fA-F-]{16,}\\z"), "{hex}").when(F.length(x) > 40, "{long}").otherwise(F.regexp_replace(x, "[0-9]+", "{n}")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in longest]
    pick = lambda values: reduce(lambda chain, x: chain.when(*x), zip(fits[1:], map(F.lit, values[1:])), F.when(fits[0], F.lit(values[0])))
    return pick([h + p for _, h, p in longest]), pick([v for v, _, _ in longest])


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "good")])


def templates(pages: DataFrame, support: int = SUPPORT, apart: float = APART, prior: float = PRIOR, pure: float = PURE) -> DataFrame:
    """(host, path) and ``good`` (true, false or null for unlabelled) -> (host, shape, template, purity, rejected).

    Pages are first counted by host and shape (their generalised segments). From the root down, at each node, a branch keeps its own segment if it has ``support`` pages and
    its labels differ from the node's by ``apart`` standard deviations; all other branches are merged into ``*``. A node with fewer than ``support`` pages isn't
    split, and what is below it is ``**``; so the tree is as deep as pages reach. A template's purity is its share of good pages, drawn to its host's share, and
    that to the share of all.

    A round takes every open node down to the first level that splits it: its shapes' segments are summed for all levels below it at once (by node and level, and by branch, with partial
    sums before the shuffle, so no task sees a whole host). Down to that level all its pages go the same way, and get the same steps. So rounds are as many
    as a page's path has splits, which need labels that differ, whatever the depth of urls. Only branches with ``support`` pages and a row for each node
    are joined back, broadcast while they are few.
    """
    shape = F.array_join(segments(F.col("path")), "/")
    counted = pages.groupBy("host", shape.alias("shape")).agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("good"))
    level = saved(counted.withColumns({"template": F.lit(""), "depth": F.lit(0)}), "shapes")
    rate = level.agg((F.coalesce(F.sum("good"), F.lit(0)) + prior) / (F.coalesce(F.sum("labelled"), F.lit(0)) + prior)).first()[0]
    tokens = F.filter(F.split("shape", "/"), lambda x: x != "")
    sums = ("n", "labelled", "good")
    done = []
    while True:
        below = F.posexplode(F.slice(tokens, F.col("depth") + 1, F.greatest(F.size(tokens) - F.col("depth"), F.lit(0))))
        branches = level.select("host", "template", "depth", *sums, below.alias("at", "token")).withColumn("at", F.col("at") + F.col("depth"))
        branches = saved(_summed(branches, "host", "template", "at", "token"), "branches")
        p = (F.col("good") + F.lit(prior) * F.lit(rate)) / (F.col("labelled") + F.lit(prior))
        nodes = _summed(branches, "host", "template", "at").select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("at").alias("_at"), F.col("n").alias("of_node"), p.alias("p"))
        nodes = small(saved(nodes, "levels"))
        gap = F.col("good") - F.col("labelled") * F.col("p")
        own = branches.filter((F.col("n") >= support) & (F.col("labelled") > 0)).join(nodes, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("at") == F.col("_at")))
        own = own.filter((F.col("of_node") >= support) & (gap * gap >= apart * apart * F.col("labelled") * F.col("p") * (1 - F.col("p"))))
        own = saved(own.select("host", "template", "at", "token", (F.col("n") == F.col("of_node")).alias("alone")), "own")
        # what each level of a node does: a step that all its pages take, or a stop, where they part or are too few
        kept = own.groupBy("host", "template", "at").agg(F.max(F.when(F.col("alone"), F.col("token"))).alias("token"), F.count_if(~F.col("alone")).alias("parting"))
        kept = small(saved(kept, "kept"))
        levels = nodes.join(kept, (F.col("_h") == F.col("host")) & (F.col("_t") == F.col("template")) & (F.col("_at") == F.col("at")), "left")
        few = F.col("of_node") < support
        step = F.struct("_at", F.concat(F.lit("/"), F.coalesce("token", F.lit("*"))).alias("step"), (few | (F.coalesce("parting", F.lit(0)) > 0)).alias("stops"), few.alias("few"))
        ways = levels.groupBy("_h", "_t").agg(F.array_sort(F.collect_list(step)).alias("way"))
        stop = F.expr("get(filter(way, x -> x.stops), 0)")
        ways = ways.select("_h", "_t", stop["_at"].alias("stop"), stop["few"].alias("few"), F.expr("transform(way, x -> x.step)").alias("steps"))
        joined = level.join(small(saved(ways, "ways")), (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
        length = F.size(tokens)
        until = F.least(length, F.coalesce("stop", length))
        passed = F.concat("template", F.array_join(F.slice(F.coalesce("steps", F.array().cast("array<string>")), F.lit(1), until - F.col("depth")), ""))
        moved = saved(joined.select("host", "shape", *sums, F.col("template").alias("_from"), passed.alias("template"), F.col("stop"), F.when(length > F.col("stop"), F.col("few")).alias("few"), F.get(tokens, F.col("stop")).alias("token")), "moved")
        done.append(moved.filter("few is null").select("host", "shape", "template", *sums))
        done.append(moved.filter("few").select("host", "shape", F.concat("template", F.lit("/**")).alias("template"), *sums))
        mine = small(own.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("at").alias("_at"), F.col("token").alias("_k")))
        at_branch = (F.col("host") == F.col("_h")) & (F.col("_from") == F.col("_t")) & (F.col("stop") == F.col("_at")) & (F.col("token") == F.col("_k"))
        parted = moved.filter("not few").join(mine, at_branch, "left")
        level = saved(parted.select("host", "shape", *sums, F.concat("template", F.lit("/"), F.coalesce("_k", F.lit("*"))).alias("template"), (F.col("stop") + 1).alias("depth")), "level")
        if level.isEmpty():
            break
    found = saved(reduce(DataFrame.unionByName, done).select("host", "shape", "template", "n", "labelled", "good"), "templated")
    of_host = _summed(found, "host").select(F.col("host").alias("_h"), ((F.col("good") + F.lit(prior) * F.lit(rate)) / (F.col("labelled") + F.lit(prior))).alias("of_host"))
    model = _summed(found, "host", "template").join(small(saved(of_host, "hosts")), F.col("host") == F.col("_h"))
    purity = (F.col("good") + F.lit(prior) * F.col("of_host")) / (F.col("labelled") + F.lit(prior))
    model = small(saved(model.select("host", "template", purity.alias("purity")), "model"))
    return found.select("host", "shape", "template").join(model, ["host", "template"]).withColumn("rejected", F.col("purity") < pure)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", good_col: str = "good", **how) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, template, purity.

    A page whose url fits a rule gets the rule's verdict, another one is blocked if its template is rejected. ``good_col``
    says of labelled pages whether they are good; null is unlabelled. Urls that are null or have no ``://`` have empty host and path,
    and share a template. Rows that repeat an id are judged each, very long urls whole. Other columns are not read. An empty table gives an empty result.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(good_col).alias("good"))
    found = small(saved(templates(rows, **how), "templates"))
    joined = rows.withColumn("shape", F.array_join(segments(F.col("path")), "/")).join(found, ["host", "shape"], "left")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("rejected"), "block").otherwise("allow"))
    return joined.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "purity")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) and ``good``: the quality of the document whose id is the first number of the path, where it is labelled.

    Pages without a number are not joined; as one null key they would meet in one task.
    """
    known = labels.groupBy(F.col("doc_id").alias("_doc")).agg((F.max("quality") == 1).alias("good"))
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})", 1)
    rows = pages.select("page_id", "url", F.when(number != "", number).cast("long").alias("_doc"))
    without = rows.filter("_doc is null").select("page_id", "url", F.lit(None).cast("boolean").alias("good"))
    return rows.filter("_doc is not null").join(known, "_doc", "left").select("page_id", "url", "good").unionByName(without)


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge(labelled(pages, labels)).select("page_id", "host", "path", "rule", "verdict", "template")


OP7_SQL = rf"""
WITH RECURSIVE u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT doc_id, max(quality) = 1 AS good FROM labels GROUP BY doc_id),
s AS (SELECT u.*, good, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9a-fA-F-]{{16,}}\z') THEN '{{hex}}'
    WHEN length(x) > 40 THEN '{{long}}' ELSE regexp_replace(x, '[0-9]+', '{{n}}', 'g') END) AS parts
  FROM u LEFT JOIN q ON q.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') AS BIGINT)),
c AS (SELECT * EXCLUDE (parts), parts AS segs, array_to_string(parts, '/') AS shape FROM s),
l0 AS (SELECT host, shape, segs, count(*) AS n, count(good) AS labelled, count(*) FILTER (good) AS good FROM c GROUP BY host, shape, segs),
g AS (SELECT (coalesce(sum(good), 0) + 8.0::DOUBLE) / (coalesce(sum(labelled), 0) + 8.0::DOUBLE) AS rate FROM l0),
l AS (SELECT host, shape, segs, n, labelled, good, rate, '' AS template, true AS open, 0 AS d FROM l0, g
  UNION ALL SELECT host, shape, segs, n, labelled, good, rate, template || CASE WHEN token IS NULL THEN '' WHEN of_node < 20 THEN '/**'
      WHEN of_branch >= 20 AND labels > 0 AND (goods - labels * p) * (goods - labels * p) >= 9.0::DOUBLE * labels * p * (1 - p) THEN '/' || token ELSE '/*' END,
    token IS NOT NULL AND of_node >= 20, d + 1
  FROM (SELECT *, sum(n) OVER w AS of_node, (sum(good) OVER w + 8.0::DOUBLE * rate) / (sum(labelled) OVER w + 8.0::DOUBLE) AS p, sum(n) OVER b AS of_branch, sum(labelled) OVER b AS labels, sum(good) OVER b AS goods
    FROM (SELECT *, segs[d + 1] AS token FROM l WHERE open) WINDOW w AS (PARTITION BY host, template, token IS NULL), b AS (PARTITION BY host, template, token))),
h AS (SELECT *, (sum(good) OVER (PARTITION BY host) + 8.0::DOUBLE * rate) / (sum(labelled) OVER (PARTITION BY host) + 8.0::DOUBLE) AS of_host FROM l WHERE NOT open),
t AS (SELECT host, shape, template, (sum(good) OVER w + 8.0::DOUBLE * of_host) / (sum(labelled) OVER w + 8.0::DOUBLE) < 0.5 AS rejected FROM h WINDOW w AS (PARTITION BY host, template)),
v AS (SELECT c.page_id, c.host, c.path, template, rejected, CASE
    WHEN (c.host = 'example.net' OR c.host LIKE '%.example.net') AND starts_with(c.path, '/en/') THEN 'example.net/en/'
    WHEN (c.host = 'example.com' OR c.host LIKE '%.example.com') AND starts_with(c.path, '/de/') THEN 'example.com/de/'
    WHEN (c.host = 'org' OR c.host LIKE '%.org') AND starts_with(c.path, '/fr/') THEN 'org/fr/'
    WHEN (c.host = 'net' OR c.host LIKE '%.net') AND starts_with(c.path, '/') THEN 'net/' END AS rule
  FROM c LEFT JOIN t ON c.host = t.host AND c.shape = t.shape)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN rejected THEN 'block' ELSE 'allow' END AS verdict, template FROM v
"""

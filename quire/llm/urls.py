"""URL filter: longest-match rules, and a character language-model ratio for the rest.

The language models are variable-order Markov models over characters (contexts of
zero to four), smoothed by Witten-Bell interpolation, one of accepted and one of
rejected URLs, learned from the URLs that rules judge. The log-likelihood
difference of a URL, divided by its length, is held against a threshold that is
calibrated on a fold of rule-judged URLs kept out of the counts. All of it is
DataFrame operations: n-gram counts with partial aggregation, a window within a
context, and one join of URL positions with the table of n-gram log ratios.

Edge cases: null URLs and URLs without ``://`` have empty host and path, no rule
fits them, and a null is scored like an empty string. With no training rows of one
class the ratio is 0 and the threshold too, which allows. Repeated rows are judged
alike and stay. Ties between rules of equal length go to the smaller string. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import stored

ORDER = 5
STRETCH, COPIES = 1000, 100_000  # n-grams of a URL, and copies of a row, that one row is exploded into
START, END = "\u0002", "\u0003"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def key_of(url: Column) -> Column:
    """Stands for a URL beside its n-grams, so that a long one isn't copied to each; null and empty are alike."""
    return F.md5(F.coalesce(url, F.lit("")).cast("binary"))


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of each URL and its end, with the up to four characters before it.

    A URL is cut into stretches of ``STRETCH`` n-grams first, so that a row copies its stretch alone.
    """
    urls = urls.withColumn("_padded", F.concat(F.lit(START * (ORDER - 1)), F.coalesce("url", F.lit("")), F.lit(END)))
    padded, grams = F.col("_padded"), F.length("_padded") - (ORDER - 1)
    stretches = F.transform(F.sequence(F.lit(0), F.floor((grams - 1) / STRETCH).cast("int")), lambda i: F.substring(padded, i * STRETCH + 1, F.lit(STRETCH + ORDER - 1)))
    rows = urls.withColumn("_s", F.explode(stretches)).select(*keep, "_s").withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_s") - (ORDER - 1))))
    return rows.select(*keep, F.substring("_s", F.col("_i"), F.lit(ORDER)).alias("g"))


def ratios(urls: DataFrame) -> DataFrame:
    """(url, a, r) to (g, ratio, n): a and r mark training URLs of the two classes; a row for each n-gram of all URLs, which hold it n times."""
    counts = stored(_grams(urls, "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count("*").alias("n")))
    both = counts.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("r"), F.lit(0))).first()
    if not both[0] or not both[1]:
        return counts.select("g", F.lit(0.0).alias("ratio"), "n")
    lower = None
    for k in range(1, ORDER + 1):
        of = counts.groupBy(F.expr(f"right(g, {k})").alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")) if k < ORDER else counts
        context = W.partitionBy(F.expr(f"left(g, {k - 1})"))
        stats = of.select("g", *[c for x in "ar" for c in (F.col(x).alias(f"n{x}"), F.sum(x).over(context).alias(f"c{x}"), F.sum(F.when(F.col(x) > 0, 1).otherwise(0)).over(context).alias(f"t{x}"))])
        if lower is None:
            stats = stats.select("*", F.lit(1 / 65536).alias("pa"), F.lit(1 / 65536).alias("pr"))
        else:
            stats = stats.join(lower, F.expr(f"right(g, {k - 1})") == F.col("_g"))
        smooth = lambda x: F.when(F.col(f"c{x}") + F.col(f"t{x}") > 0, (F.col(f"n{x}") + F.col(f"t{x}") * F.col(f"p{x}")) / (F.col(f"c{x}") + F.col(f"t{x}"))).otherwise(F.col(f"p{x}"))
        lower = stats.select(F.col("g").alias("_g"), smooth("a").alias("pa"), smooth("r").alias("pr"))
    return counts.join(lower, F.col("g") == F.col("_g")).select("g", F.log(F.col("pa") / F.col("pr")).alias("ratio"), "n")


def looked_up(urls: DataFrame, keys: list[str], table: DataFrame, most_broadcast: int) -> DataFrame:
    """(keys, ratio) for each place of each URL.

    A table of at most ``most_broadcast`` n-grams goes to all tasks. Of a larger one
    only the n-grams that take more than that share of all places do, of which there
    can't be more; so none that is left is frequent when the rest is joined by a shuffle.
    """
    grams = _grams(urls, *keys)
    size, places = table.agg(F.count("*"), F.sum("n")).first()
    if size <= most_broadcast:
        return grams.join(F.broadcast(table.drop("n")), "g").select(*keys, "ratio")
    often = F.col("n") > places / most_broadcast
    first = grams.join(F.broadcast(table.where(often).drop("n")), "g", "left")
    rest = first.where("ratio IS NULL").drop("ratio").join(table.where(~often), "g")
    return first.where("ratio IS NOT NULL").select(*keys, "ratio").unionAll(rest.select(*keys, "ratio"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, most_broadcast: int = 400_000) -> DataFrame:
    """One row per input row: the id, host, path, rule, verdict.

    The models learn from all distinct URLs that rules judge, but for a fold of
    three in sixteen by md5, which only calibrates. URLs that a rule fits need no score.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    allow, held = F.col("rule.verdict") == "allow", F.ascii(F.md5(F.col("url").cast("binary"))) % 5 == 0
    known = stored(rows.groupBy("url", allow.alias("allow")).agg(F.lit(1).alias("one")).select("url", key_of(F.col("url")).alias("key"), F.col("allow").cast("long").alias("allow"), F.coalesce(held, F.lit(False)).alias("held")))
    learns = F.col("allow").isNotNull() & ~F.col("held")
    marks = [F.when(learns, x).otherwise(0).cast("long").alias(name) for name, x in (("a", F.col("allow")), ("r", 1 - F.col("allow")))]
    table = stored(ratios(known.select("url", *marks)))

    def scored(urls: DataFrame, *keys: str) -> DataFrame:
        return looked_up(urls, list(keys), table, most_broadcast).groupBy(*keys).agg((F.sum("ratio") / F.count("*")).alias("d"))

    fold = scored(known.where("held AND allow IS NOT NULL"), "key", "allow").groupBy("allow").agg(F.avg("d").alias("m"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("s")).collect()
    of = {r["allow"]: (r["m"], r["s"] + 1e-9) for r in fold}
    # Where two normal curves of the classes are equally many deviations away.
    threshold = (of[1][0] * of[0][1] + of[0][0] * of[1][1]) / (of[0][1] + of[1][1]) if len(of) == 2 else 0.0
    told = scored(known.where("allow IS NULL").dropDuplicates(["key"]), "key").select(F.col("key").alias("_key"), "d")
    method = rows.where("rule IS NULL").drop("rule").join(told, key_of(F.col("url")) == F.col("_key")).select("id", "copies", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("d") >= threshold, "allow").otherwise("block").alias("verdict"))
    out = rows.where("rule IS NOT NULL").select("id", "copies", "host", "path", "rule.rule", "rule.verdict").unionAll(method)
    # Repeated rows again, by parts, as one array of all would have no bound.
    out = out.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int"))))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("_part") * COPIES).cast("int"))))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


SQL = r"""
WITH rows_ AS (SELECT page_id, url,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule, h, p) AS (VALUES ('allow','org/','org','/'), ('block','example.org/es/','example.org','/es/'), ('block','example.org/en/1','example.org','/en/1'), ('allow','com/fr/','com','/fr/'), ('block','com/de/','com','/de/')),
hp AS (SELECT DISTINCT host, path FROM rows_),
best AS (SELECT host, path, rule, verdict FROM (SELECT hp.host, hp.path, rule, verdict, row_number() OVER (PARTITION BY hp.host, hp.path ORDER BY length(rule) DESC, rule) AS k
  FROM hp JOIN rules ON (hp.host = h OR ends_with(hp.host, '.' || h)) AND starts_with(hp.path, p)) WHERE k = 1),
judged AS (SELECT r.*, b.rule, b.verdict AS ruled FROM rows_ r LEFT JOIN best b USING (host, path)),
known AS (SELECT DISTINCT url, ruled FROM judged),
train AS (SELECT url, ruled = 'allow' AS allow, ascii(substr(md5(url), 1, 1)) % 5 = 0 AS held FROM known WHERE ruled IS NOT NULL),
urls AS (SELECT url, allow::int AS a, 1 - allow::int AS r FROM train WHERE NOT held UNION ALL SELECT url, 0, 0 FROM known),
padded AS (SELECT a, r, repeat(chr(2), 4) || coalesce(url, '') || chr(3) AS x FROM urls),
g5 AS (SELECT g, sum(a) AS a, sum(r) AS r FROM (SELECT a, r, substr(x, i::int, 5) AS g FROM (SELECT a, r, x, unnest(range(1, length(x) - 3)) AS i FROM padded)) GROUP BY g),
s1 AS (SELECT g, (a + ta / 65536) / (ca + ta) AS pa, (r + tr / 65536) / (cr + tr) AS pr FROM (SELECT *, sum(a) OVER w AS ca, sum(r) OVER w AS cr, count(*) FILTER (a > 0) OVER w AS ta, count(*) FILTER (r > 0) OVER w AS tr FROM (SELECT right(g, 1) AS g, sum(a) AS a, sum(r) AS r FROM g5 GROUP BY 1) WINDOW w AS (PARTITION BY 1))),
""" + "".join(
    f"""s{k} AS (SELECT q.g, CASE WHEN ca + ta > 0 THEN (q.a + ta * l.pa) / (ca + ta) ELSE l.pa END AS pa, CASE WHEN cr + tr > 0 THEN (q.r + tr * l.pr) / (cr + tr) ELSE l.pr END AS pr FROM (SELECT *, sum(a) OVER w AS ca, sum(r) OVER w AS cr, count(*) FILTER (a > 0) OVER w AS ta, count(*) FILTER (r > 0) OVER w AS tr FROM (SELECT right(g, {k}) AS g, sum(a) AS a, sum(r) AS r FROM g5 GROUP BY 1) WINDOW w AS (PARTITION BY left(g, {k - 1}))) q JOIN s{k - 1} l ON l.g = right(q.g, {k - 1})),
"""
    for k in range(2, ORDER + 1)
) + r"""ratio AS (SELECT g, CASE WHEN (SELECT sum(a) > 0 AND sum(r) > 0 FROM g5) THEN ln(pa / pr) ELSE 0 END AS x FROM s5),
scored AS (SELECT url, sum(ratio.x) / count(*) AS d FROM (SELECT url, substr(p, i::int, 5) AS g FROM (SELECT url, p, unnest(range(1, length(p) - 3)) AS i FROM (SELECT url, repeat(chr(2), 4) || coalesce(url, '') || chr(3) AS p FROM known))) JOIN ratio USING (g) GROUP BY url),
fold AS (SELECT allow, avg(d) AS m, stddev_pop(d) + 1e-9 AS s FROM train JOIN scored USING (url) WHERE held GROUP BY allow),
cut AS (SELECT coalesce((SELECT (x.m * y.s + y.m * x.s) / (x.s + y.s) FROM fold x, fold y WHERE x.allow AND NOT y.allow), 0) AS t)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN d >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM judged LEFT JOIN scored ON judged.url IS NOT DISTINCT FROM scored.url, cut
"""

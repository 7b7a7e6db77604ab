"""URL verdicts by rules and, where none fits, by a tree of path templates per host.

Segments with digits become patterns, rare ones (under a twentieth of their place in the host) a wildcard. The templates
of a host form a tree. A branch whose share of blocked labels does not differ from its parent's (chi-square, 5 %) is
merged with its like siblings. A template is rejected when its blocked share, smoothed towards its host's
and this towards the whole table's, reaches ``REJECT``. Labels are the verdicts of the rules.

Pages are reduced to (host, template) counts before anything else is joined, so a host with a third of all pages costs
one row per template.

Cases: a null url or one without ``://`` has an empty host and path and is judged like any other template; repeated rows
are judged each for itself; of rules of one length the first wins; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules of the query, verdict and rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
RARE, CHI, SMOOTH_HOST, SMOOTH_TEMPLATE, REJECT = 20, 3.84, 2.0, 4.0, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of every page."""
    url = F.col("url").cast("string")
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(cast(url as string), locate('://', cast(url as string)) + 3)")).otherwise("")
    rows = pages.select("page_id", rest.alias("rest"))
    raw = F.regexp_extract("rest", "^[^/?#]*", 0)
    return rows.select("page_id", F.translate(raw, UPPER, LOWER).alias("host"),
                       F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))


def ruled(rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as (rule, verdict)."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` and the template's ``purity`` (share blocked) of every page."""
    shape = lambda s: F.regexp_replace(s, "[0-9]+", "{n}")
    inner = F.when(F.col("path").startswith("/"), F.expr("substring(path, 2)")).otherwise(F.col("path"))
    rows = parsed(pages).withColumn("found", ruled(rules)).select(
        "page_id", "host", "path", "found.rule", F.col("found.verdict").alias("ruled"), shape(inner).alias("shape"))

    counts = rows.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.count("ruled").alias("n"),
                                               F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("b"))
    placed = counts.select("host", "shape", "pages", "n", "b", F.posexplode(F.split("shape", "/")).alias("at", "segment"))
    seen = placed.groupBy("host", "at", "segment").agg(F.sum("pages").alias("seen"))
    of = seen.groupBy("host", "at").agg(F.sum("seen").alias("of"))
    common = placed.join(seen, ["host", "at", "segment"]).join(of, ["host", "at"]).withColumn(
        "segment", F.when(F.col("segment").contains("{n}") | (F.col("seen") * RARE >= F.col("of")), F.col("segment")).otherwise("{x}"))
    paths = common.groupBy("host", "shape").agg(
        F.first("n").alias("n"), F.first("b").alias("b"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "segment"))), lambda s: s["segment"]).alias("segments"))

    nodes = paths.select("host", "shape", "n", "b", F.posexplode("segments").alias("at", "segment"), "segments").select(
        "host", "shape", "at", "segment", "n", "b", F.array_join(F.slice("segments", 1, F.col("at") + 1), "/").alias("node"),
        F.when(F.col("at") > 0, F.array_join(F.slice("segments", 1, F.col("at")), "/")).otherwise("").alias("parent"))
    branch = nodes.groupBy("host", "at", "parent", "node").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    family = branch.groupBy("host", "at", "parent").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    # (b - n p)^2 <= chi n p (1 - p), times all_n^2
    same = (F.pow(F.col("b") * F.col("all_n") - F.col("n") * F.col("all_b"), F.lit(2.0))
            <= CHI * F.col("n") * F.col("all_b") * (F.col("all_n") - F.col("all_b")))
    merged = branch.join(family, ["host", "at", "parent"]).select("host", "at", "parent", "node", same.alias("same"))
    templates = nodes.join(merged, ["host", "at", "parent", "node"]).groupBy("host", "shape").agg(
        F.first("n").alias("n"), F.first("b").alias("b"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("same"), "*").otherwise(F.col("segment")).alias("segment")))),
                                 lambda s: s["segment"]), "/").alias("template"))

    whole = counts.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("share"))
    hosts = counts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).crossJoin(whole).select(
        "host", ((F.col("b") + SMOOTH_HOST * F.col("share")) / (F.col("n") + SMOOTH_HOST)).alias("prior"))
    purity = templates.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).join(hosts, "host").select(
        "host", "template", ((F.col("b") + SMOOTH_TEMPLATE * F.col("prior")) / (F.col("n") + SMOOTH_TEMPLATE)).alias("purity"))
    verdicts = templates.select("host", "shape", "template").join(purity, ["host", "template"])
    return rows.join(verdicts, ["host", "shape"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity")


ORACLE = """
with parts as (
    select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parsed as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules(verdict, rule, rhost, rpath) as (values
    ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
    ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
    ('block', 'com/de/', 'com', '/de/')),
fitting as (
    select host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as ruled
    from (select distinct host, path from parsed) p
    join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by host, path),
shaped as (
    select page_id, host, path, rule, ruled,
           regexp_replace(case when starts_with(path, '/') then substr(path, 2) else path end, '[0-9]+', '{n}', 'g') as shape
    from parsed left join fitting using (host, path)),
counts as (
    select host, shape, count(*) as pages, count(ruled) as n, count(*) filter (ruled = 'block') as b from shaped group by all),
placed as (
    select host, shape, pages, n, b, unnest(string_split(shape, '/')) as segment, generate_subscripts(string_split(shape, '/'), 1) as pos
    from counts),
seen as (select host, pos, segment, sum(pages) as seen from placed group by all),
general as (
    select p.host, p.shape, p.n, p.b, p.pos,
           case when contains(p.segment, '{n}') or s.seen * 20 >= sum_of then p.segment else '{x}' end as segment
    from placed p join seen s using (host, pos, segment)
    join (select host, pos, sum(seen) as sum_of from seen group by all) o using (host, pos)),
nodes as (
    select host, shape, n, b, pos, segment, string_agg(segment, '/') over w as node,
           coalesce(string_agg(segment, '/') over (partition by host, shape order by pos rows between unbounded preceding and 1 preceding), '') as parent
    from general window w as (partition by host, shape order by pos)),
branch as (select host, pos, parent, node, sum(n) as n, sum(b) as b from nodes group by all),
family as (select host, pos, parent, sum(n) as all_n, sum(b) as all_b from branch group by all),
merged as (
    select host, pos, parent, node, pow((b * all_n - n * all_b)::double, 2) <= 3.84::double * n * all_b * (all_n - all_b) as same
    from branch join family using (host, pos, parent)),
templates as (
    select host, shape, any_value(n) as n, any_value(b) as b,
           string_agg(case when same then '*' else segment end, '/' order by pos) as template
    from nodes join merged using (host, pos, parent, node) group by host, shape),
hosts as (
    select host, (sum(b) + 2::double * (select (coalesce(sum(b), 0) + 1) / (coalesce(sum(n), 0) + 2)::double from counts))
                 / (sum(n) + 2::double) as prior from counts group by host),
purity as (
    select host, template, (sum(n.b) + 4::double * any_value(prior)) / (sum(n.n) + 4::double) as purity
    from templates n join hosts using (host) group by host, template)
select page_id, host, path, rule, coalesce(ruled, case when purity >= 0.8::double then 'block' else 'allow' end) as verdict, template, purity
from shaped join templates using (host, shape) join purity using (host, template)
"""

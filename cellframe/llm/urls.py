"""URL filters: explicit rules first, then a path-template tree per host judged by labelled purity.

The tree is grown level by level from (host, path) counts.

* Wildcards.  A segment becomes `*` if it is a number (with or without an extension), or if its parent has at least
  `min_children` different segments there and they are more than `distinct_share` of the parent's urls.
* Merging.  Of the other segments, siblings merge into one branch, `~`, if their labels and their shapes agree with
  those of all siblings together: at least `least_labels` labels each, a bad share within `z` standard errors of the
  pooled one, and shares of urls that end there, and that go on with a number, within `shape` of the pooled ones.
  A sibling with fewer labels is not known to be alike and keeps a branch of its own.
* Depth.  Every path is split `depth` levels deep.  Below that a node is split on only while its labels are mixed,
  however deep its urls go; else its deeper segments share the branch `**`.
* Verdict.  A template's bad share is smoothed towards its host's, and the host's towards the whole table's; a
  template is rejected at `block_at` and above.

Every step is a join or aggregate of built-in expressions; urls are counted per (host, path) before anything else,
and each level is written to the shared folder, so that it is computed once.

Defined cases: a url that is null or has no `://` has an empty host and path and is allowed; a url without
a label counts for the tree's shape only; a host without any label is allowed, but for the rules; the same
url in many rows is judged once; other columns of the input are kept, whatever their names, but for host, path, rule,
verdict, template and bad_share, which the results replace.  Urls of any length are read whole; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, small_side, staged, table, unboxed

#: (verdict, rule); a rule is a host and a path that starts with a slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEPTH = 3
MIN_CHILDREN = 8
DISTINCT_SHARE = 0.5
LEAST_LABELS = 8
Z = 2.0
SHAPE = 0.2
SMOOTHING = 10.0
BLOCK_AT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"^[0-9]+(\.[a-z]+)?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of _host and _path, null where none fits; of those that fit, the longest."""
    hit = lambda rule: (F.col("_host").eqNullSafe(rule.split("/")[0]) | F.col("_host").endswith("." + rule.split("/")[0])) & F.col("_path").startswith(rule[rule.index("/") :])
    found = [(hit(rule), rule, verdict) for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]))]
    chain = lambda i: reduce(lambda c, f: c.when(f[0], f[i]), found[1:], F.when(found[0][0], found[0][i]))
    return chain(1), chain(2)


def _branches(df: DataFrame, k: int, min_children: int, distinct_share: float, least_labels: int, z: float, shape: float) -> DataFrame:
    """(_host, _template, _s, _branch): the branch that each segment of level k takes."""
    more = F.size("_seg") - (k + 1)
    here = df.where((F.size("_seg") > k) & ~F.col("_done")).select(
        "_host", "_template", F.get("_seg", F.lit(k)).alias("_s"), "n", "n_lab", "n_bad",
        F.when(more <= 0, F.col("n")).otherwise(0).alias("ends"), F.when(F.get("_seg", F.lit(k + 1)).rlike(NUMBER), F.col("n")).otherwise(0).alias("nums"),
    )
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    child = here.groupBy("_host", "_template", "_s").agg(*sums("n", "n_lab", "n_bad", "ends", "nums"))
    parent = child.groupBy("_host", "_template").agg(F.count(F.lit(1)).alias("kinds"), *[F.sum(c).alias(f"p_{c}") for c in ("n", "n_lab", "n_bad", "ends", "nums")])
    c = F.col
    wild = c("_s").rlike(NUMBER) | ((c("kinds") >= min_children) & (c("kinds") > distinct_share * c("p_n")))
    pool = (c("p_n_bad") + 1.0) / (c("p_n_lab") + 2.0)
    labels = F.abs((c("n_bad") + 2.0 * pool) / (c("n_lab") + 2.0) - pool) <= z * F.sqrt(pool * (1.0 - pool) / (c("n_lab") + 2.0))
    alike = lambda x: F.abs(c(x).cast("double") / c("n") - c(f"p_{x}").cast("double") / c("p_n")) <= shape
    near = (c("kinds") > 1) & (c("n_lab") >= least_labels) & labels & alike("ends") & alike("nums")
    branch = F.when(wild, "*").when(near, "~").otherwise(c("_s"))
    return child.join(parent, ["_host", "_template"]).select("_host", "_template", "_s", branch.alias("_branch"))


def template_tree(
    urls: DataFrame, depth: int = DEPTH, min_children: int = MIN_CHILDREN, distinct_share: float = DISTINCT_SHARE, least_labels: int = LEAST_LABELS, z: float = Z, shape: float = SHAPE
) -> DataFrame:
    """(_host, _path, n, n_lab, n_bad) to the same rows with _template."""
    df = urls.withColumns({"_seg": F.filter(F.split("_path", "/"), lambda s: s != ""), "_template": F.lit(""), "_done": F.lit(False)})
    k = 0
    while True:
        df = staged(df, f"level{k}")
        deeper = (F.size("_seg") > k) & ~F.col("_done")
        if not df.where(deeper).head(1):
            return df.drop("_seg", "_done")
        if k >= depth:  # nodes whose labels are not mixed stop here
            mixed = df.where(deeper).groupBy("_host", "_template").agg(F.sum("n_lab").alias("lab"), F.sum("n_bad").alias("bad")).where("bad > 0 and bad < lab")
            mixed = small_side(staged(mixed.select(F.col("_host").alias("_h"), F.col("_template").alias("_t")), f"mixed{k}"))
            df = df.join(mixed, (F.col("_host") == F.col("_h")) & (F.col("_template") == F.col("_t")), "left").withColumn("_stop", deeper & F.col("_h").isNull())
            df = df.withColumns({"_template": F.when(F.col("_stop"), F.concat("_template", F.lit("/**"))).otherwise(F.col("_template")), "_done": F.col("_done") | F.col("_stop")})
            df = staged(df.drop("_h", "_t", "_stop"), f"stopped{k}")
        made = small_side(staged(_branches(df, k, min_children, distinct_share, least_labels, z, shape), f"branch{k}"))
        df = df.withColumn("_s", F.when(deeper, F.get("_seg", F.lit(k)))).join(made, ["_host", "_template", "_s"], "left")
        df = df.withColumn("_template", F.when(F.col("_branch").isNull(), F.col("_template")).otherwise(F.concat("_template", F.lit("/"), "_branch"))).drop("_s", "_branch")
        k += 1


def template_verdicts(tree: DataFrame, smoothing: float = SMOOTHING, block_at: float = BLOCK_AT) -> DataFrame:
    """(_host, _template, _labelled, _host_labelled, _bad_share, _rejected); a host without labels is not rejected."""
    by_template = tree.groupBy("_host", "_template").agg(F.sum("n_lab").alias("lab"), F.sum("n_bad").alias("bad"))
    by_host = by_template.groupBy("_host").agg(F.sum("lab").alias("hlab"), F.sum("bad").alias("hbad"))
    every = by_template.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("lab"), F.lit(0)) + 4.0)).alias("p"))
    host_share = (F.col("hbad") + smoothing * every.scalar()) / (F.col("hlab") + smoothing)
    share = (F.col("bad") + smoothing * F.col("host_share")) / (F.col("lab") + smoothing)
    df = by_template.join(by_host.select("_host", F.col("hlab").alias("_host_labelled"), host_share.alias("host_share")), "_host").select("_host", "_template", F.col("lab").alias("_labelled"), "_host_labelled", share.alias("_bad_share"))
    return df.withColumn("_rejected", (F.col("_host") != "") & (F.col("_host_labelled") > 0) & (F.col("_bad_share") >= block_at))


def url_filter(pages: DataFrame, labels: DataFrame, url: str = "url", rules=RULES, **tree_options) -> DataFrame:
    """pages with host, path, rule, verdict, template, bad_share.

    labels: (url_key, bad) with bad 0 or 1; url_key is the document number at the end of a url's path.
    """
    parsed = pages.select(boxed(pages), F.col(url).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    parsed = parsed.withColumns({"_host": host, "_path": path}).drop("_url")
    judged = judged_urls(parsed, labels, **tree_options).select("_host", "_path", "_template", "_bad_share", "_rejected")
    rule, verdict = rule_columns(rules)
    out = parsed.join(small_side(staged(judged, "judged")), ["_host", "_path"], "left")
    return out.select(
        *unboxed(pages, ("host", "path", "rule", "verdict", "template", "bad_share")),
        F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_rejected"), "block").otherwise("allow")).alias("verdict"),
        F.col("_template").alias("template"), F.round("_bad_share", 9).alias("bad_share"),
    )


def judged_urls(parsed: DataFrame, labels: DataFrame, **tree_options) -> DataFrame:
    """(_host, _path, n, n_lab, n_bad, _template, _labelled, _host_labelled, _bad_share, _rejected) of each distinct url of (_host, _path)."""
    counted = parsed.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("_key", F.expr("try_cast(nullif(regexp_extract(_path, '/([0-9]+)[^/0-9]*/?$', 1), '') as bigint)"))
    marks = labels.groupBy("url_key").agg(F.max("bad").alias("bad"))
    urls = counted.join(marks, F.col("_key") == F.col("url_key"), "left").select(
        "_host", "_path", "n", F.when(F.col("bad").isNull(), 0).otherwise(F.col("n")).alias("n_lab"), (F.coalesce("bad", F.lit(0)) * F.col("n")).cast("long").alias("n_bad")
    )
    tree = template_tree(urls, **tree_options)
    return tree.join(small_side(staged(template_verdicts(tree), "verdicts")), ["_host", "_template"])


def query(spark, sf_dir):
    """A page's label is that of the document whose number ends its path: bad if of quality 0 or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("url_key"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), labels).select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")


#: Levels that the SQL goes down; the tree itself goes as deep as its urls.
SQL_LEVELS = 5


def _level(k: int) -> str:
    """The k-th level of the tree in DuckDB's SQL."""
    stop = f"(len(seg) > {k} and not done and not coalesce(m.mixed, false))" if k >= DEPTH else "false"
    alike = lambda x: f"abs({x}::double / n - p{x}::double / pn) <= {SHAPE}::double"
    near = f"abs((bad + 2.0::double * pool) / (lab + 2.0::double) - pool) <= {Z}::double * sqrt(pool * (1.0::double - pool) / (lab + 2.0::double))"
    return f"""
m{k} as materialized (select host, template, sum(n_bad) > 0 and sum(n_bad) < sum(n_lab) as mixed from t{k} where len(seg) > {k} and not done group by all),
h{k} as materialized (select t.host, t.path, seg, n, n_lab, n_bad, case when {stop} then t.template || '/**' else t.template end as template, done or {stop} as done,
    case when len(seg) > {k} and not done and not {stop} then seg[{k + 1}] end as s from t{k} t left join m{k} m on t.host = m.host and t.template = m.template),
c{k} as materialized (select host, template, s, sum(n)::bigint as n, sum(n_lab)::bigint as lab, sum(n_bad)::bigint as bad, sum(case when len(seg) <= {k + 1} then n else 0 end)::bigint as ends,
    sum(case when regexp_matches(seg[{k + 2}], '{NUMBER}') then n else 0 end)::bigint as nums from h{k} where s is not null group by host, template, s),
p{k} as materialized (select host, template, sum(n)::bigint as pn, count(*) as kinds, sum(ends)::bigint as pends, sum(nums)::bigint as pnums,
    (sum(bad)::bigint + 1.0::double) / (sum(lab)::bigint + 2.0::double) as pool from c{k} group by all),
b{k} as materialized (select c.host, c.template, c.s, case
    when regexp_matches(c.s, '{NUMBER}') or (kinds >= {MIN_CHILDREN} and kinds > {DISTINCT_SHARE}::double * pn) then '*'
    when kinds > 1 and lab >= {LEAST_LABELS} and {near} and {alike("ends")} and {alike("nums")} then '~'
    else c.s end as branch from c{k} c join p{k} p on c.host = p.host and c.template = p.template),
t{k + 1} as materialized (select h.host, h.path, h.seg, n, n_lab, n_bad, case when branch is null then h.template else h.template || '/' || branch end as template, done
    from h{k} h left join b{k} b on h.host = b.host and h.template = b.template and h.s = b.s),"""


def _rules_sql(i: int) -> str:
    whens = []
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        whens.append(f"when (host = '{host}' or host like '%.{host}') and starts_with(path, '{path}') then '{(rule, verdict)[i]}'")
    return "case " + " ".join(whens) + " end"


SQL = f"""
with u as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages
), q as (
  select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u
), n as (
  select host, path, count(*) as n, try_cast(nullif(regexp_extract(path, '/([0-9]+)[^/0-9]*/?$', 1), '') as bigint) as k from q group by host, path
), m as (
  select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by doc_id
), t0 as (
  select host, path, list_filter(string_split(path, '/'), lambda x: x <> '') as seg, n, case when bad is null then 0 else n end as n_lab,
    coalesce(bad, 0) * n as n_bad, '' as template, false as done from n left join m on k = doc_id
),{"".join(_level(k) for k in range(SQL_LEVELS))}
t as (select host, path, n_lab, n_bad, template from t{SQL_LEVELS}),
v as (select host, template, sum(n_lab)::bigint as lab, sum(n_bad)::bigint as bad from t group by all),
g as (select (coalesce(sum(bad), 0)::bigint + 1.0::double) / (coalesce(sum(lab), 0)::bigint + 4.0::double) as p from v),
w as (select host, sum(lab)::bigint as hlab, (sum(bad)::bigint + {SMOOTHING}::double * any_value(p)) / (sum(lab)::bigint + {SMOOTHING}::double) as hs from v, g group by host),
x as (select v.host, v.template, hlab, (bad + {SMOOTHING}::double * hs) / (lab + {SMOOTHING}::double) as share from v join w on v.host = w.host),
j as (select t.host, t.path, t.template, share, t.host <> '' and hlab > 0 and share >= {BLOCK_AT}::double as rejected from t join x on t.host = x.host and t.template = x.template)
select page_id, q.host, q.path, {_rules_sql(0).replace("host", "q.host").replace("path", "q.path")} as rule,
  coalesce({_rules_sql(1).replace("host", "q.host").replace("path", "q.path")}, case when rejected then 'block' else 'allow' end) as verdict,
  template, round(share, 9) as bad_share
from q join j on q.host = j.host and q.path = j.path
"""

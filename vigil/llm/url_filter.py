"""URL filter: host and path rules, and a path-template tree for the rest.

The tree of a host has one level for each path segment.  Numbers in a segment
are wildcards from the start.  Level by level, children whose labelled share
of bad rows doesn't differ from that of their siblings (two-proportion z below
``Z``) are merged into a wildcard; a child that is apart stays, however many
siblings it has.  A template's purity is its share of bad labelled rows, smoothed by ``PRIOR``
rows of its parent's purity, from the rate of all labelled rows down; a
template of at least ``REJECT`` is rejected.

Everything is counted: rows are first summed by (host, path with wildcards),
so a host or template that holds a third of all rows is few rows afterwards;
the joins back are equi-joins left to skew-join splitting.  The tree has
``DEPTH`` levels; segments below are one last segment of it, so no path is
left out.

Defined cases: a null url, or one without ``://``, has an empty host and an
empty path, and is judged by that host's tree.  Urls with a null label don't
count for the purity.  Without any labelled row nothing is rejected.  Repeated
rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import written

DEPTH = 6
Z = 1.96
PRIOR = 5.0
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # allow or block, host, path


def parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict, or nulls.
    Of rules that are equal but for the verdict, block wins."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def segments() -> Column:
    """Path segments with numbers as wildcards, the rest below DEPTH as one."""
    plain = F.filter(F.split(F.regexp_replace("path", "[0-9]+", "*"), "/"), lambda x: x != "")
    head = F.slice(plain, 1, DEPTH - 1)
    last = F.concat_ws("/", F.slice(plain, F.lit(DEPTH), F.greatest(F.size(plain), F.lit(1))))
    return F.when(F.size(plain) < DEPTH, plain).otherwise(F.concat(head, F.array(last)))


def templates(paths: DataFrame) -> DataFrame:
    """Generalise ``paths`` (host, shape, n, bad): adds ``g``, the template."""
    out = written(paths.withColumn("g", F.col("shape")), "templates")
    deepest = out.agg(F.max(F.size("g"))).first()[0] or 0  # at most DEPTH
    for d in range(deepest):
        at = out.withColumns({"prefix": F.concat_ws("/", F.slice("g", 1, d)) if d else F.lit(""),
                              "seg": F.get("g", F.lit(d))})
        child = at.filter("seg IS NOT NULL").groupBy("host", "prefix", "seg").agg(F.sum("n").alias("cn"), F.sum("bad").alias("cb"))
        node = child.groupBy("host", "prefix").agg(F.count("*").alias("kids"), F.sum("cn").alias("nn"), F.sum("cb").alias("nb"))
        n1, n2, b1, b2 = F.col("cn"), F.col("nn") - F.col("cn"), F.col("cb"), F.col("nb") - F.col("cb")
        p = F.col("nb") / F.col("nn")
        spread = p * (1 - p) * (1 / n1.cast("double") + 1 / n2.cast("double"))
        apart = (n1 > 0) & (n2 > 0) & (F.col("nb") > 0) & (F.col("nb") < F.col("nn"))
        gap = b1 / n1 - b2 / n2
        similar = ~F.when(apart, gap * gap >= Z * Z * spread).otherwise(F.lit(False))
        wild = (F.col("kids") > 1) & similar
        new = child.join(node, ["host", "prefix"]).select(
            "host", "prefix", "seg", F.when(wild, F.lit("*")).otherwise(F.col("seg")).alias("to"))
        g = F.concat(F.slice("g", 1, d), F.array("to"), F.slice(F.col("g"), F.lit(d + 2), F.lit(DEPTH))) if d else \
            F.concat(F.array("to"), F.slice(F.col("g"), F.lit(2), F.lit(DEPTH)))
        out = written(at.join(new, ["host", "prefix", "seg"], "left").select(
            "host", "shape", "n", "bad", F.when(F.col("to").isNull(), F.col("g")).otherwise(g).alias("g")), "templates")
    return out


def purity(tree: DataFrame) -> DataFrame:
    """(host, g, purity) of every template, smoothed from the root down."""
    total = tree.agg(F.sum("n").alias("n"), F.sum("bad").alias("b")).first()
    prior = float(total.b) / float(total.n) if total.n else 0.0
    leaves = tree.groupBy("host", "g").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    chain = leaves.select("*", F.explode(F.sequence(F.lit(0), F.size("g"))).alias("d")) \
        .withColumn("prefix", F.when(F.col("d") > 0, F.concat_ws("/", F.slice(F.col("g"), F.lit(1), F.col("d")))).otherwise(""))
    node = chain.groupBy("host", "d", "prefix").agg(F.sum("n").alias("nn"), F.sum("bad").alias("nb"))
    return chain.join(node, ["host", "d", "prefix"]).groupBy("host", "g") \
        .agg(F.array_sort(F.collect_list(F.struct("d", "nn", "nb"))).alias("levels")) \
        .select("host", "g", F.aggregate("levels", F.lit(prior), lambda p, x: (
            (x["nb"].cast("double") + F.lit(PRIOR) * p) / (x["nn"].cast("double") + F.lit(PRIOR)))).alias("purity"))


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", bad_col: str = "bad") -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity added;
    columns of these names are replaced.  ``bad_col`` is a nullable Boolean
    label; it decides nothing but the counts."""
    base = pages.drop("host", "path", "rule", "verdict", "template", "purity")
    host, path = parts(url_col)
    rows = base.withColumns({"host": host, "path": path}).withColumn("_shape", segments())
    tree = templates(rows.groupBy("host", F.col("_shape").alias("shape")).agg(
        F.count(bad_col).alias("n"), F.sum(F.coalesce(F.col(bad_col), F.lit(False)).cast("long")).alias("bad")))
    judged = tree.join(purity(tree), ["host", "g"]).select(
        F.col("host").alias("_host"), F.col("shape").alias("_of"), F.concat(F.lit("/"), F.concat_ws("/", "g")).alias("template"), "purity")
    name, verdict = rule_columns(rules)
    return rows.join(judged, (F.col("host") == F.col("_host")) & (F.col("_shape") == F.col("_of"))) \
        .withColumn("rule", name) \
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))) \
        .select(*base.columns, "host", "path", "rule", "verdict", "template", "purity")


def duckdb_sql(rules: list[Rule], rows: str) -> str:
    """The judgement in DuckDB SQL; ``rows`` gives (page_id, url, bad)."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
            for v, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "block"))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    sql = f"""
WITH src AS ({rows}),
cut AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM src),
hp AS (SELECT page_id, bad, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
sg AS (SELECT *, [x for x in string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/') if x <> ''] AS plain FROM hp),
shaped AS (SELECT *, CASE WHEN len(plain) < {DEPTH} THEN plain
         ELSE list_append(plain[1:{DEPTH - 1}], array_to_string(plain[{DEPTH}:], '/')) END AS shape FROM sg),
t0 AS (SELECT host, shape, shape AS g, count(bad) AS n, count(*) FILTER (WHERE bad) AS bad FROM shaped GROUP BY host, shape)"""
    for d in range(DEPTH):
        sql += f""",
a{d} AS (SELECT *, array_to_string(g[1:{d}], '/') AS prefix, g[{d + 1}] AS seg FROM t{d}),
c{d} AS (SELECT host, prefix, seg, sum(n) AS cn, sum(bad) AS cb FROM a{d} WHERE seg IS NOT NULL GROUP BY ALL),
k{d} AS (SELECT host, prefix, count(*) AS kids, sum(cn) AS nn, sum(cb) AS nb FROM c{d} GROUP BY ALL),
m{d} AS (SELECT host, prefix, seg, (kids > 1 AND NOT CASE
           WHEN cn > 0 AND nn > cn AND nb > 0 AND nb < nn
           THEN power(cb / cn - (nb - cb) / (nn - cn), 2) >= {Z} * {Z} * (nb / nn) * (1 - nb / nn) * (1.0::DOUBLE / cn + 1.0::DOUBLE / (nn - cn))
           ELSE false END) AS wild FROM c{d} JOIN k{d} USING (host, prefix)),
t{d + 1} AS (SELECT a.host, a.shape, CASE WHEN m.wild THEN list_concat(list_append(a.g[1:{d}], '*'), a.g[{d + 2}:]) ELSE a.g END AS g,
           a.n, a.bad FROM a{d} a LEFT JOIN m{d} m ON a.host = m.host AND a.prefix = m.prefix AND a.seg = m.seg)"""
    p = "prior"
    joins = ""
    for d in range(DEPTH + 1):
        sql += f""",
n{d} AS (SELECT host, array_to_string(g[1:{d}], '/') AS prefix, sum(n) AS nn, sum(bad) AS nb FROM t{DEPTH} WHERE len(g) >= {d} GROUP BY ALL)"""
        joins += f"\n  LEFT JOIN n{d} ON l.host = n{d}.host AND len(l.g) >= {d} AND array_to_string(l.g[1:{d}], '/') = n{d}.prefix"
        p = f"CASE WHEN n{d}.nn IS NULL THEN {p} ELSE (n{d}.nb::DOUBLE + {PRIOR} * {p}) / (n{d}.nn::DOUBLE + {PRIOR}) END" if d \
            else f"(n{d}.nb::DOUBLE + {PRIOR} * {p}) / (n{d}.nn::DOUBLE + {PRIOR})"
    return sql + f""",
prior AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(n), 0)::DOUBLE, 0) AS prior FROM t0),
leaf AS (SELECT l.host, l.shape, '/' || array_to_string(l.g, '/') AS template, {p} AS purity
  FROM t{DEPTH} l CROSS JOIN prior{joins})
SELECT s.page_id, s.host, s.path, {rule.replace('host', 's.host').replace('path', 's.path')} AS rule,
  coalesce({verdict.replace('host', 's.host').replace('path', 's.path')}, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
  template
FROM shaped s JOIN leaf ON s.host = leaf.host AND s.shape = leaf.shape"""

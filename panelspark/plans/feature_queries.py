"""Queries for engineered features, motifs and prototypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import features as ops
from panelspark.operators import motifs, relations
from panelspark.plans import fixtures as fx
from panelspark.plans.registry import draw_sql, query, r, spearman_sql, sql
from panelspark.plans.source_queries import KEY_SQL
from panelspark.session import all_rows

# Relationships as a mining run returns them; the second names an absent column.
RELATIONSHIPS = [
    {"feature1": "feature_quantity", "feature2": "feature_discount", "strength": 0.9},
    {"feature1": "feature_quantity", "feature2": "feature_absent", "strength": 0.8},
    {"feature1": "feature_discount", "feature2": "feature_tax", "strength": 0.7},
    {"feature1": "feature_price", "feature2": "feature_tax", "strength": 0.5},
]


def _made_sql(expressions: dict[str, str], digits: int = 4) -> str:
    cols = ", ".join(f'round({e}, {digits}) + 0.0 AS "{n}"' for n, e in expressions.items())
    return sql(f"SELECT era, {KEY_SQL}, {cols} FROM panel", "panel")


def _made(df, digits: int = 4):
    base = {"era", "era_idx", *fx.KEYS, *fx.FEATURES, *fx.TARGETS}
    new = [c for c in df.columns if c not in base]
    return df.select("era", *fx.KEYS, *[r(c, digits).alias(c) for c in new])


def _single(e: str) -> str:
    return f"cast(cast({e} AS float) AS double)"


@query(
    _made_sql(
        {
            "path_00_tityxount": _single("feature_quantity * feature_discount * 0.9::double"),
            "path_02_ountx_tax": _single("feature_discount * feature_tax * 0.7::double"),
            "path_03_ricex_tax": _single("feature_price * feature_tax * 0.5::double"),
        },
        2,
    )
)
def interaction_features(spark, sf):
    return _made(ops.interaction_features(fx.panel(spark, sf), RELATIONSHIPS), 2)


def _yolo_sql() -> str:
    out = {}
    for i, e in enumerate(RELATIONSHIPS):
        a, b, s = e["feature1"], e["feature2"], e["strength"]
        if b == "feature_absent":
            continue
        out[f"path_{i:02d}_ratio_{a[-4:]}_{b[-4:]}"] = _single(
            f"{a} / (abs({b}) + 1e-6::double) * {s}::double"
        )
        out[f"path_{i:02d}_diff_{a[-4:]}_{b[-4:]}"] = _single(f"({a} - {b}) * {s}::double")
    return _made_sql(out, 1)


@query(_yolo_sql())
def yolo_features(spark, sf):
    return _made(ops.yolo_features(fx.panel(spark, sf), RELATIONSHIPS), 1)


BASE = ["feature_quantity", "feature_price", "target_order"]


# The tax is often 0, so its ratios reach 1e12 and are compared to two digits.
ZERO_BASE = ["feature_quantity", "feature_price", "feature_tax"]


def _math_sql(base: list[str], digits: int) -> str:
    out, i = {}, 0
    for x, a in enumerate(base):
        for b in base[x + 1 :]:
            tail = f"{a.split('_')[-1]}_{b.split('_')[-1]}_{i:02d}"
            out[f"ratio_{tail}"] = f"{a} / (abs({b}) + 1e-8::double)"
            out[f"diff_{tail}"] = f"{a} - {b}"
            i += 1
    cols = ", ".join(f'round({e}, {digits}) + 0.0 AS "{n}"' for n, e in out.items())
    return sql(f"SELECT era, {KEY_SQL}, {cols} FROM gappy", "gappy")


@query(_math_sql(BASE, 4))
def math_features(spark, sf):
    return _made(ops.math_features(fx.gappy_panel(spark, sf), BASE))


@query(_math_sql(ZERO_BASE, 2))
def math_features_zero(spark, sf):
    return _made(ops.math_features(fx.gappy_panel(spark, sf), ZERO_BASE), 2)


@query(
    sql(
        " UNION ALL ".join(
            f"SELECT era, {KEY_SQL}, {i} AS pair, round({a} / (abs({b}) + 1e-8::double), 2) + 0.0 AS ratio, "
            f"round({a} - {b}, 4) + 0.0 AS diff FROM gappy"
            for i, (a, b) in enumerate(ops.pairs_of(BASE))
        ),
        "gappy",
    )
)
def math_pairs(spark, sf):
    """The mathematical features in long form, as wide feature lists need it."""
    out = ops.math_pairs(fx.gappy_panel(spark, sf), ["era", *fx.KEYS], BASE)
    return out.select("era", *fx.KEYS, F.col("pair").cast("int").alias("pair"), r("ratio", 2).alias("ratio"),
                      r("diff", 4).alias("diff"))


@query(
    sql(
        f"""
WITH c AS ({spearman_sql("(SELECT feature, value, target_net FROM cells)", "feature", "value", "target_net")})
SELECT era, {KEY_SQL}, """
        + ", ".join(
            f"round({f} - 0.5 * (SELECT corr FROM c WHERE feature = '{f}') * target_net, 4) + 0.0 AS {f}_neutralized"
            for f in fx.FEATURES
        )
        + " FROM panel",
        "cells",
    )
)
def neutralize(spark, sf):
    return _made(ops.neutralize(fx.panel(spark, sf), fx.FEATURES, "target_net"))


@query(
    sql(
        " UNION ALL ".join(
            f"SELECT {i} AS pair_idx, '{a}' AS feature1, '{b}' AS feature2, "
            f"round(avg(cast({a} IS NOT NULL AND {b} IS NOT NULL AS double)), 6) + 0.0 AS valid_share FROM gappy"
            for i, (a, b) in enumerate(ops.pairs_of(fx.FEATURES))
        ),
        "gappy",
    )
)
def feature_pairs(spark, sf):
    out = ops.feature_pairs(fx.gappy_panel(spark, sf), fx.FEATURES)
    return out.withColumn("valid_share", r("valid_share"))


@query(
    sql(
        f"SELECT era, {KEY_SQL}, round(coalesce(feature_quantity, 0), 4) + 0.0 AS feature_quantity, "
        "round(coalesce(target_gross, 0), 4) + 0.0 AS target_gross FROM gappy",
        "gappy",
    )
)
def impute_zero(spark, sf):
    made = ops.impute_zero(fx.gappy_panel(spark, sf), ["feature_quantity", "target_gross"])
    return made.select(
        "era", *fx.KEYS, *[r(c, 4).alias(c) for c in ("feature_quantity", "target_gross")]
    )


@query(
    sql(
        f"SELECT era, {KEY_SQL}, round(coalesce(feature_quantity, median(feature_quantity) OVER (PARTITION BY era), 0), 6) + 0.0 AS feature_quantity, "
        "round(coalesce(target_gross, median(target_gross) OVER (PARTITION BY era), 0), 6) + 0.0 AS target_gross FROM gappy",
        "gappy",
    )
)
def impute_median(spark, sf):
    made = ops.impute_median(fx.gappy_panel(spark, sf), ["feature_quantity", "target_gross"])
    return made.select(
        "era", *fx.KEYS, *[r(c).alias(c) for c in ("feature_quantity", "target_gross")]
    )


STAT_SQL = "SELECT avg({0}) AS m, stddev_samp({0}) AS s FROM panel WHERE era_idx <= 60"


@query(
    sql(
        f"SELECT era, {KEY_SQL}, "
        + ", ".join(
            f"({f} - (SELECT m FROM ({STAT_SQL.format(f)}))) / (SELECT CASE WHEN s < 1e-12 THEN 1 ELSE s END FROM ({STAT_SQL.format(f)})) > 0 AS {f}"
            for f in ("feature_quantity", "feature_price")
        )
        + " FROM panel",
        "panel",
    )
)
def zpos_binarize(spark, sf):
    """Statistics of the first 60 eras, applied to all rows."""
    p = fx.panel(spark, sf)
    names = ["feature_quantity", "feature_price"]
    made = ops.zpos_binarize(p, names, p.where("era_idx <= 60"))
    return made.select("era", *fx.KEYS, *names)


TVERSKY_SQL = sql(
    """
WITH long AS (SELECT vec_id, label, i, features[i] AS x FROM vectors, unnest(range(1, 65)) AS u(i)),
stats AS (SELECT i, avg(x) AS m, stddev_samp(x) AS s FROM long GROUP BY i),
bits AS (SELECT vec_id, label, i, (x - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END > 0 AS b FROM long JOIN stats USING (i)),
proto AS (SELECT label AS k, i, b AS p FROM bits WHERE vec_id IN (SELECT min(vec_id) FROM vectors GROUP BY label))
SELECT vec_id, k AS prototype, round(sum(cast(CASE WHEN b AND p THEN 1.0 WHEN b THEN -0.7 WHEN p THEN -0.3 ELSE 0 END AS double)), 6) + 0.0 AS score
FROM bits JOIN proto USING (i) GROUP BY vec_id, k""",
    "vectors",
)


@query(TVERSKY_SQL)
def tversky(spark, sf):
    """Similarity of every vector with the first vector of each label."""
    bits = ops.zpos_array(fx.vectors(spark, sf), "features")
    firsts = bits.groupBy("label").agg(F.min_by("bits", "vec_id").alias("bits")).orderBy("label")
    protos = all_rows(firsts)
    scored = ops.tversky_scores(bits, "bits", [p["bits"] for p in protos])
    cells = [
        F.struct(F.lit(p["label"]).alias("prototype"), r(f"tversky_{i}").alias("score"))
        for i, p in enumerate(protos)
    ]
    return scored.select("vec_id", F.inline(F.array(*cells)))


def _centre_sql(k: int) -> str:
    steps = [
        "c0 AS (SELECT 0 AS pos, vec_id, cast(0 AS double) AS distance, features AS f FROM vectors ORDER BY vec_id LIMIT 1)"
    ]
    for i in range(1, k):
        gaps = [f"list_distance(v.features, c{j}.f)" for j in range(i)]
        near = f"least({', '.join(gaps)})" if i > 1 else gaps[0]
        joins = " ".join(f"CROSS JOIN c{j}" for j in range(i))
        steps.append(
            f"c{i} AS (SELECT {i} AS pos, v.vec_id, {near} AS distance, v.features AS f FROM vectors v {joins} "
            "ORDER BY distance DESC, v.vec_id LIMIT 1)"
        )
    union = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(k))
    return sql(
        f"WITH {', '.join(steps)} SELECT pos, vec_id, round(distance, 6) + 0.0 AS distance FROM ({union})",
        "vectors",
    )


@query(_centre_sql(4))
def k_center_prototypes(spark, sf):
    v = fx.vectors(spark, sf)
    start = v.agg(F.min("vec_id")).first()[0]
    out = ops.k_center_prototypes(v, "features", "vec_id", 4, start)
    return out.withColumn("distance", r("distance"))


def _motif_sql(tail: str, select: str) -> str:
    spans = []
    for n in (2, 3):
        for i in range(len(fx.BINNED) - n + 1):
            names = fx.BINNED[i : i + n]
            values = " || '|' || ".join(f"cast(cast({c} AS int) AS varchar)" for c in names)
            keys = ", ".join(names)
            spans.append(
                f"SELECT {i} AS start, {n} AS size, {values} AS motif_values, count(*) AS count, "
                f"avg(target) AS avg_target, avg(target) * ln(1 + count(*)) AS score FROM panel_binned GROUP BY {keys}"
            )
    return sql(f"SELECT {select} FROM ({' UNION ALL '.join(spans)}) {tail}", "panel_binned")


MOTIF_SELECT = (
    "start, motif_values, count, round(avg_target * count, 9) + 0.0 AS sum_target, round(score, 6) + 0.0 AS score"
)


def _values_text():
    return F.concat_ws("|", F.transform("motif_values", lambda v: v.cast("int").cast("string")))


@query(_motif_sql("", MOTIF_SELECT))
def motif_mine(spark, sf):
    out = motifs.motif_mine(fx.panel_binned(spark, sf), fx.BINNED, "target", [2, 3])
    return out.select(
        "start",
        _values_text().alias("motif_values"),
        "count",
        r(F.col("avg_target") * F.col("count"), 9).alias("sum_target"),
        r("score").alias("score"),
    )


@query(_motif_sql("WHERE count >= 10 ORDER BY score DESC LIMIT 25", MOTIF_SELECT))
def top_motifs(spark, sf):
    mined = motifs.motif_mine(fx.panel_binned(spark, sf), fx.BINNED, "target", [2, 3])
    out = motifs.top_motifs(mined, fx.BINNED, 10, 25)
    return out.select(
        "start",
        _values_text().alias("motif_values"),
        "count",
        r(F.col("avg_target") * F.col("count"), 9).alias("sum_target"),
        r("score").alias("score"),
    )


MOTIFS = [
    {"motif_features": ["feature_0", "feature_1"], "motif_values": [4.0, 5.0]},
    {"motif_features": ["feature_2", "feature_absent"], "motif_values": [1.0, 1.0]},
    {"motif_features": ["feature_1", "feature_2", "feature_3"], "motif_values": [3.0, 2.0, 1.0]},
]


def _flag_sql() -> str:
    def near(c, v):
        return f"abs({c} - {v}) <= 1e-8 + 1e-5 * abs({v})"

    return sql(
        f"""
SELECT era, "motif_00_re_0_re_1", "motif_02_re_1_re_2_re_3", count(*) AS n FROM (
  SELECT era, cast({near('feature_0', 4.0)} AND {near('feature_1', 5.0)} AS tinyint) AS "motif_00_re_0_re_1",
         cast({near('feature_1', 3.0)} AND {near('feature_2', 2.0)} AND {near('feature_3', 1.0)} AS tinyint) AS "motif_02_re_1_re_2_re_3"
  FROM panel_binned) GROUP BY ALL""",
        "panel_binned",
    )


@query(_flag_sql())
def motif_flags(spark, sf):
    made = motifs.motif_flags(fx.panel_binned(spark, sf), MOTIFS)
    flags = [c for c in made.columns if c.startswith("motif_")]
    return made.groupBy("era", *flags).agg(F.count(F.lit(1)).alias("n"))


def _scaled(spark, sf):
    """Binned features and target on [0, 1], the range walks are made for."""
    p = fx.panel_binned(spark, sf)
    tops = {"feature_0": 5.0, "feature_1": 10.0, "feature_2": 8.0, "feature_3": 7.0}
    return p.withColumns({c: F.col(c) / top for c, top in tops.items()})


@query()
def mine_relationships(spark, sf):
    mined = relations.mine_relationships(_scaled(spark, sf), fx.BINNED, "target")
    return mined.edges.withColumn("strength", r("strength"))


@query()
def relationship_paths(spark, sf):
    mined = relations.mine_relationships(_scaled(spark, sf), fx.BINNED, "target")
    return mined.paths.select(F.array_join("path", "-").alias("path"), r("success", 3).alias("success"))


SHORT = {"n_paths": 2, "max_length": 3, "batches": 2}
SCALES = {"feature_quantity": (10, 5.0), "feature_discount": (0.01, 10.0), "feature_tax": (0.01, 8.0), "l_linenumber": (1, 7.0)}


def _short_walks_sql() -> str:
    """The walks of two rounds spelled out: draws are 64-bit hashes of the row's keys, as in the operator."""
    n, whole = len(SCALES), 1 << 64
    golden, column = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
    columns = f"[{', '.join(str(column * (j + 1) % whole) for j in range(n))}]::ubigint[]"

    def times(a, c):
        return f"(({a})::uhugeint * {c}::uhugeint % {whole}::uhugeint)::ubigint"

    def plus(a, b):
        return f"((({a})::uhugeint + ({b})::uhugeint) % {whole}::uhugeint)::ubigint"

    def mixed(e):
        one = f"list_transform([{e}], lambda a: {times('xor(a, a >> 30)', 0xBF58476D1CE4E5B9)})"
        two = f"list_transform({one}, lambda a: {times('xor(a, a >> 27)', 0x94D049BB133111EB)})"
        return f"list_transform({two}, lambda a: xor(a, a >> 31))[1]"

    def drawn(e, key):
        return mixed(plus(e, str(golden * (key + 1) % whole)))

    start = [float(v) for i in range(n) for v in relations.start_strengths(i, n, 42)]
    xs = ", ".join(f"cast(floor({c} / {float(width)!r}::double + 1e-9::double) AS double) / {float(top)!r}::double" for c, (width, top) in SCALES.items())
    parts = [f"""
base AS MATERIALIZED (SELECT {draw_sql(fx.KEYS)} AS d, [{xs}] AS x, target_net / 100000.0::double AS y FROM panel),
s0 AS (SELECT {start!r}::double[] AS s)"""]
    for turn in range(SHORT["batches"]):
        walks = []
        for p in range(SHORT["n_paths"]):
            parts.append(f"""
w{turn}_{p}_0 AS (SELECT x, y, base, cur, [cur] AS path, x[cur] AS total, 1.0::double AS weight, true AS alive, s FROM (
  SELECT x, y, base, (base % {n})::int + 1 AS cur, s FROM (
    SELECT x, y, {drawn("d::ubigint", p)} AS base, s FROM base CROSS JOIN s{turn} WHERE d % {SHORT["batches"]} = {turn})))""")
            for t in range(1, SHORT["max_length"]):
                noise = f"({mixed(plus('u', f'({columns})[j]'))} >> 11)::double * ({relations.NOISE!r}::double / {2.0**53!r}::double)"
                parts.append(f"""
w{turn}_{p}_{t} AS (
  SELECT x, y, base, s, CASE WHEN go THEN nxt ELSE cur END AS cur, CASE WHEN go THEN list_append(path, nxt) ELSE path END AS path,
         CASE WHEN go THEN total + x[nxt] * w ELSE total END AS total, CASE WHEN go THEN weight + w ELSE weight END AS weight,
         go AND NOT (abs((total + x[nxt] * w) / (weight + w) - y) < 0.1) AS alive
  FROM (SELECT *, alive AND best.v >= 0.1 AS go, best.j AS nxt, s[(cur - 1) * {n} + best.j] AS w FROM (
    SELECT *, list_max(list_transform(range(1, {n + 1}), lambda j: {{'v': CASE WHEN list_contains(path, j) THEN 0 ELSE s[(cur - 1) * {n} + j] END + {noise}, 'j': j::int}})) AS best
    FROM (SELECT *, {drawn("base", t)} AS u FROM w{turn}_{p}_{t - 1}))))""")
            walks.append(f"SELECT path, greatest(0, 1 - 2 * abs(total / weight - y)) AS success FROM w{turn}_{p}_{SHORT['max_length'] - 1} WHERE len(path) > 1")
        parts.append(f"""
won{turn} AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(walks)}) WHERE success > 0),
e{turn} AS (SELECT path[k] AS i, path[k + 1] AS j, 0.05 * 0.02 * sum(success) AS g FROM won{turn}, unnest(range(1, {SHORT["max_length"]})) AS u(k)
  WHERE k < len(path) GROUP BY 1, 2)""")
        edges = " UNION ALL ".join(f"SELECT i, j, g FROM e{k} UNION ALL SELECT j, i, g FROM e{k}" for k in range(turn + 1))
        parts.append(f"""
g{turn} AS (SELECT (i - 1) * {n} + j AS slot, sum(g) AS g FROM ({edges}) GROUP BY 1),
s{turn + 1} AS (SELECT list(least(3.0, v + coalesce(g, 0)) ORDER BY k) AS s
  FROM (SELECT unnest(s) AS v, unnest(range(1, {n * n + 1})) AS k FROM s0) LEFT JOIN g{turn} ON k = slot)""")
    last = SHORT["batches"]
    won = " UNION ALL ".join(f"SELECT * FROM won{k}" for k in range(last))
    return sql(f"""
WITH {",".join(parts)},
won AS ({won})
SELECT 'edge' AS kind, (i - 1) || '-' || (j - 1) AS name, round(s[(i - 1) * {n} + j] * 0.95, 4) + 0.0 AS value
FROM s{last}, unnest(range(1, {n + 1})) AS a(i), unnest(range(1, {n + 1})) AS b(j) WHERE i < j
UNION ALL SELECT 'node', (f - 1)::varchar, round(sum(success) * 0.05 * 0.95, 3) + 0.0 FROM (SELECT unnest(path) AS f, success FROM won) GROUP BY f
UNION ALL SELECT 'path', array_to_string(list_transform(list_sort(path), lambda f: (f - 1)::varchar), '-') AS name, round(sum(success) * 0.95, 2) + 0.0
FROM won GROUP BY name HAVING sum(success) * 0.95 >= 0.01""", "panel")


@query(_short_walks_sql())
def mine_relationships_short(spark, sf):
    """Two rounds of short walks whose draws come from the row's keys: edges, importance and path memory."""
    columns = {c: F.floor(F.col(c) / width + 1e-9).cast("double") / top for c, (width, top) in SCALES.items()}
    p = fx.panel(spark, sf).select(*fx.KEYS, *[e.alias(f"x_{c}") for c, e in columns.items()], (F.col("target_net") / 100000.0).alias("y"))
    mined = relations.mine_relationships(p, [f"x_{c}" for c in SCALES], "y", keys=fx.KEYS, **SHORT)
    edges = mined.edges.select(F.lit("edge").alias("kind"), F.concat_ws("-", "f1_idx", "f2_idx").alias("name"), r("strength", 4).alias("value"))
    nodes = mined.importance.where("importance > 0").select(F.lit("node").alias("kind"), F.col("idx").cast("string").alias("name"), r("importance", 3).alias("value"))
    paths = mined.paths.select(F.lit("path").alias("kind"), F.array_join("path", "-").alias("name"), r("success", 2).alias("value"))
    return edges.unionByName(nodes).unionByName(paths)


def _edge_corrs(spark, sf):
    """Edges with absolute correlation as strength, for the operators after mining."""
    from panelspark.functions.correlation import pearson_of

    p = fx.panel_binned(spark, sf)
    cells = [
        F.struct(
            F.lit(i).alias("f1_idx"),
            F.lit(j).alias("f2_idx"),
            F.lit(a).alias("feature1"),
            F.lit(b).alias("feature2"),
            (F.coalesce(F.abs(pearson_of(a, b)), F.lit(0.0)) * 100).alias("strength"),
        )
        for i, a in enumerate(fx.BINNED)
        for j, b in enumerate(fx.BINNED)
        if i != j
    ]
    return p.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def _edge_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS f1_idx, {j} AS f2_idx, '{a}' AS feature1, '{b}' AS feature2, "
        f"coalesce(abs(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)), 0) * 100 AS strength FROM panel_binned"
        for i, a in enumerate(fx.BINNED)
        for j, b in enumerate(fx.BINNED)
        if i != j
    )


@query(
    sql(
        f"SELECT feature1, feature2, round(strength, 6) + 0.0 AS strength FROM ({_edge_sql()}) "
        "WHERE f1_idx < f2_idx AND strength >= 0.25 ORDER BY strength DESC LIMIT 3",
        "panel_binned",
    )
)
def top_relationships(spark, sf):
    out = relations.top_relationships(_edge_corrs(spark, sf), 0.25, 3)
    return out.select("feature1", "feature2", r("strength").alias("strength"))


@query(
    sql(
        f"""
SELECT least(count(*) FILTER (f1_idx < f2_idx AND strength >= 0.25), 20) AS relationships,
       round(max(strength), 6) + 0.0 AS max_strength,
       count(*) FILTER (f1_idx < f2_idx AND strength >= 0.25) > 0 AND max(strength) >= 0.2 AS passed
FROM ({_edge_sql()})""",
        "panel_binned",
    )
)
def relationship_sanity(spark, sf):
    out = relations.relationship_sanity(_edge_corrs(spark, sf))
    return out.withColumn("max_strength", r("max_strength"))

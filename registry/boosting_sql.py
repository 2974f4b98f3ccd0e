"""SQL that grows small boosted trees over the same borders, level by level or leaf by leaf.

A node is named by its path from the root: 0 for left, 1 for right.
"""

from __future__ import annotations

from collections.abc import Sequence


class Growth:
    """Collects the statements of one model; ``nodes`` has one row per node of its trees."""

    def __init__(self, name: str, rows: str, features: Sequence[str], mode: str, steps: int, rate: float, l2: float, min_rows: int, min_curvature: float, prior: bool):
        self.name, self.features, self.mode, self.steps = name, features, mode, steps
        self.rate, self.l2, self.min_rows, self.min_curvature = rate, l2, min_rows, min_curvature
        self.parts: list[str] = []
        self.nodes: list[str] = []
        start = f"(SELECT ln(avg(y) / (1 - avg(y))) FROM {rows})" if prior else "0.0"
        self.parts.append(f"{name}_m0 AS (SELECT *, CAST({start} AS DOUBLE) AS margin FROM {rows})")
        values = " UNION ALL ".join(f"SELECT DISTINCT '{f}' AS feature, {i} AS place, {f} AS cut FROM {rows}" for i, f in enumerate(features))
        self.parts.append(f"{name}_cuts AS (SELECT * FROM ({values}) QUALIFY cut > min(cut) OVER (PARTITION BY feature))")

    def score(self, g: str, h: str) -> str:
        return f"({g}) * ({g}) / greatest(({h}) + {self.l2}, 1e-300)"

    def tree(self, t: int) -> None:
        n, score = f"{self.name}_t{t}", self.score
        self.parts.append(f"{n}_p AS (SELECT *, 1 / (1 + exp(-margin)) AS p FROM {self.name}_m{t})")
        self.parts.append(f"{n}_a0 AS (SELECT *, p - y AS g, p * (1 - p) AS h, '' AS node, 0 AS depth FROM {n}_p)")
        for k in range(self.steps):
            a = f"{n}_a{k}"
            long = " UNION ALL ".join(f"SELECT node, depth, '{f}' AS feature, {f} AS v, g, h FROM {a}" for f in self.features)
            self.parts.append(f"{n}_v{k} AS (SELECT node, depth, feature, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({long}) GROUP BY ALL)")
            self.parts.append(f"{n}_s{k} AS (SELECT node, any_value(depth) AS depth, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {a} GROUP BY node)")
            self.parts.append(
                f"""{n}_l{k} AS (SELECT s.node, s.depth, c.feature, c.place, c.cut, s.g, s.h, s.n, sum(v.g) AS gl, sum(v.h) AS hl, sum(v.n) AS nl
                  FROM {n}_s{k} s JOIN {n}_v{k} v USING (node) JOIN {self.name}_cuts c ON c.feature = v.feature AND v.v < c.cut
                  GROUP BY s.node, s.depth, c.feature, c.place, c.cut, s.g, s.h, s.n)"""
            )
            gain = f"0.5 * ({score('gl', 'hl')} + {score('g - gl', 'h - hl')} - {score('g', 'h')})"
            able = f"least(nl, n - nl) >= {self.min_rows} AND least(hl, h - hl) >= {self.min_curvature}"
            self.parts.append(f"{n}_g{k} AS (SELECT node, depth, feature, place, cut, g, h, n, {gain} AS gain FROM {n}_l{k} WHERE {able}{'' if self.mode == 'symmetric' else f' AND {gain} > 1e-12'})")
            if self.mode == "symmetric":
                self.parts.append(
                    f"""{n}_b{k} AS (SELECT s.node, s.depth, b.feature, b.cut, s.g, s.h, s.n, b.gain
                      FROM {n}_s{k} s, (SELECT feature, place, cut, sum(gain) AS gain FROM {n}_g{k} GROUP BY ALL ORDER BY 4 DESC, 2, 3 LIMIT 1) b)"""
                )
            else:
                over = "PARTITION BY node " if self.mode == "level" else ""
                order = "gain DESC, place, cut" if self.mode == "level" else "gain DESC, node, place, cut"
                self.parts.append(f"{n}_b{k} AS (SELECT node, depth, feature, cut, g, h, n, gain FROM {n}_g{k} QUALIFY row_number() OVER ({over}ORDER BY {order}) = 1)")
            self.nodes.append(f"SELECT '{self.name}' AS model, {t} AS tree, node, depth, feature, cut AS threshold, gain, g, h, n, NULL::DOUBLE AS value FROM {n}_b{k}")
            side = "CASE " + " ".join(f"WHEN feature = '{f}' THEN CAST({f} >= cut AS INTEGER)" for f in self.features) + " END"
            self.parts.append(
                f"""{n}_a{k + 1} AS (SELECT x.* EXCLUDE (node, depth), CASE WHEN b.node IS NULL THEN x.node ELSE x.node || {side} END AS node,
                  x.depth + CAST(b.node IS NOT NULL AS INTEGER) AS depth FROM {n}_a{k} x LEFT JOIN {n}_b{k} b ON x.node = b.node)"""
            )
        self.parts.append(
            f"""{n}_leaf AS (SELECT node, any_value(depth) AS depth, sum(g) AS g, sum(h) AS h, count(*) AS n,
              -{self.rate} * sum(g) / greatest(sum(h) + {self.l2}, 1e-300) AS value FROM {n}_a{self.steps} GROUP BY node)"""
        )
        self.nodes.append(f"SELECT '{self.name}', {t}, node, depth, NULL, NULL, 0.0, g, h, n, value FROM {n}_leaf")
        self.parts.append(
            f"{self.name}_m{t + 1} AS (SELECT x.* EXCLUDE (p, g, h, node, depth, margin), margin + value AS margin FROM {n}_a{self.steps} x JOIN {n}_leaf USING (node))"
        )

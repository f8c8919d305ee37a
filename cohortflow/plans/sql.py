"""Composable WITH-clause fragments for the SQL twins."""

from __future__ import annotations

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def fragment(name: str, sql: str, *needs: str) -> None:
    FRAGMENTS[name] = (needs, sql)


def with_query(final: str, *needs: str) -> str:
    """``WITH`` every needed fragment in dependency order, then the final SELECT."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in FRAGMENTS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in needs:
        visit(name)
    recursive = any("_rec" in n for n in ordered)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({FRAGMENTS[n][1]})" for n in ordered) + "\n" + final


def r6(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Round to 6 digits without a negative zero."""
    out = f"(CASE WHEN abs({expr}) < 5e-{digits + 1} THEN 0.0::DOUBLE ELSE round(({expr})::DOUBLE, {digits}) END)"
    return f"{out} AS {name}" if name else out


def metric_sql(t: str = "t", p: str = "p") -> dict[str, str]:
    """Aggregates of one group of complete pairs, undefined ones NULL."""
    return {
        "mse": f"avg(({t}-{p})*({t}-{p}))",
        "mae": f"avg(abs({t}-{p}))",
        "pcc": f"CASE WHEN count(*)>=2 AND max({t})>min({t}) AND max({p})>min({p}) THEN covar_pop({t},{p})/(stddev_pop({t})*stddev_pop({p})) END",
        "r2": f"CASE WHEN count(*)>=2 AND var_pop({t})*count(*)>1e-15 THEN 1-avg(({t}-{p})*({t}-{p}))/var_pop({t}) END",
    }


SEED = 7

fragment(
    "p1_cells",
    """SELECT user_id::VARCHAR AS unit, date_diff('day', DATE '2024-01-01', ts::DATE)::DOUBLE AS time,
      user_id::VARCHAR || '@' || date_diff('day', DATE '2024-01-01', ts::DATE)::VARCHAR AS observation_id,
      'c' || (user_id % 2)::VARCHAR AS condition, 'b' || (user_id % 3)::VARCHAR AS batch,
      CASE WHEN event_type IN ('purchase','error') THEN 'protein' WHEN event_type IN ('click','signup','view') THEN 'rna' END AS modality,
      event_type AS feature, round(avg(value), 6) AS raw
    FROM events GROUP BY ALL""",
)
fragment(
    "p1_obs",
    """SELECT observation_id, unit, time, condition, batch, bool_or(modality='rna') AS has_rna,
      bool_or(modality='protein') AS has_protein FROM p1_cells GROUP BY ALL""",
    "p1_cells",
)


def _split(name: str, source: str, seed: int = SEED) -> None:
    fragment(
        f"{name}_units",
        f"""SELECT unit, position, CASE WHEN position <= n_train THEN 'train' WHEN position <= n_train + n_val THEN 'val' ELSE 'test' END AS split
        FROM (SELECT unit, row_number() OVER (ORDER BY md5('{seed}:' || unit), unit) AS position,
                round_even(0.6 * count(*) OVER (), 0)::BIGINT AS n_train,
                CASE WHEN round_even(0.6 * count(*) OVER (), 0) + round_even(0.2 * count(*) OVER (), 0) >= count(*) OVER ()
                  THEN greatest(1, count(*) OVER () - round_even(0.6 * count(*) OVER (), 0)::BIGINT - 1)
                  ELSE round_even(0.2 * count(*) OVER (), 0)::BIGINT END AS n_val
              FROM (SELECT DISTINCT unit FROM {source}))""",
        source,
    )
    fragment(
        f"{name}_norm",
        f"""SELECT c.*, u.split, CASE WHEN modality = 'rna' THEN
            CASE WHEN sum(raw) OVER (PARTITION BY observation_id, modality) > 0
              THEN ln(1 + raw / sum(raw) OVER (PARTITION BY observation_id, modality) * 1e6) END
          WHEN raw > 0 THEN log2(raw) END AS normalized
        FROM {name}_cells c JOIN {name}_units u USING (unit)""",
        f"{name}_cells", f"{name}_units",
    )
    fragment(
        f"{name}_scaler",
        f"""SELECT modality, feature, avg(normalized) AS mean, stddev_pop(normalized) AS std,
          CASE WHEN stddev_pop(normalized) < 1e-12 THEN 1.0 ELSE stddev_pop(normalized) END AS scale, count(normalized) AS n_fit
        FROM {name}_norm WHERE split = 'train' GROUP BY ALL""",
        f"{name}_norm",
    )
    fragment(
        f"{name}_scaled",
        f"""SELECT n.*, (normalized - mean) / scale AS scaled FROM {name}_norm n
        LEFT JOIN {name}_scaler s USING (modality, feature)""",
        f"{name}_norm", f"{name}_scaler",
    )


_split("p1", "p1_obs")
fragment(
    "p1_steps",
    """SELECT o.unit, o.time, o.observation_id, o.condition, o.batch, u.split,
      row_number() OVER w AS step,
      last_value(CASE WHEN h.observation_id IS NOT NULL THEN o.time END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_any
    FROM p1_obs o JOIN p1_units u USING (unit)
    LEFT JOIN (SELECT DISTINCT observation_id FROM p1_scaled WHERE modality='protein' AND scaled IS NOT NULL) h USING (observation_id)
    WINDOW w AS (PARTITION BY o.unit ORDER BY o.time)""",
    "p1_obs", "p1_units", "p1_scaled",
)
fragment(
    "p1_inst",
    """SELECT a.unit || ':' || coalesce(b.last_any, b.time)::VARCHAR || '->' || a.time::VARCHAR AS instance_id,
      a.unit AS group_id, a.condition, a.batch, a.split, a.time AS target_time,
      coalesce(b.last_any, b.time) AS history_time, a.time - coalesce(b.last_any, b.time) AS delta_t,
      a.observation_id AS target_observation, h.observation_id AS history_observation, b.step AS history_step
    FROM p1_steps a JOIN p1_steps b ON a.unit = b.unit AND b.step = a.step - 1
    JOIN p1_steps h ON h.unit = a.unit AND h.time = coalesce(b.last_any, b.time)""",
    "p1_steps",
)
fragment(
    "p1_targets",
    """SELECT i.*, c.feature, c.scaled AS y_true FROM p1_inst i
    JOIN p1_scaled c ON c.observation_id = i.target_observation AND c.modality = 'protein' AND c.scaled IS NOT NULL""",
    "p1_inst", "p1_scaled",
)
fragment(
    "p1_lv",
    """SELECT t.*, coalesce(l.scaled, m.mean, 0) AS y_pred FROM p1_targets t
    LEFT JOIN p1_scaled l ON l.observation_id = t.history_observation AND l.feature = t.feature AND l.modality = 'protein'
    LEFT JOIN (SELECT observation_id, avg(scaled) AS mean FROM p1_scaled WHERE modality='protein' GROUP BY 1) m
      ON m.observation_id = t.history_observation""",
    "p1_targets", "p1_scaled",
)
fragment(
    "p2_lines",
    """SELECT l_orderkey, p_brand, p_type, l_quantity, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
fragment(
    "p2_meta",
    """SELECT o_orderkey, year(o_orderdate)::DOUBLE AS time, c_mktsegment AS condition, r_name AS batch
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
fragment(
    "p2_cells",
    """SELECT o_orderkey::VARCHAR AS observation_id, o_orderkey::VARCHAR AS unit, time, condition, batch, modality, feature, raw
    FROM (SELECT l_orderkey, 'rna' AS modality, p_brand AS feature, sum(l_quantity) AS raw FROM p2_lines GROUP BY ALL
          UNION ALL SELECT l_orderkey, 'protein', p_type, sum(l_extendedprice) FROM p2_lines GROUP BY ALL)
    JOIN p2_meta ON l_orderkey = o_orderkey""",
    "p2_lines", "p2_meta",
)
fragment(
    "p2_obs",
    """SELECT DISTINCT observation_id, unit, time, condition, batch FROM p2_cells""",
    "p2_cells",
)
_split("p2", "p2_obs")

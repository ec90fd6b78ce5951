"""Queries on the option chain."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import enrich as N
from ..operators import options as O
from ..panel import ratio
from .fixtures import CHAIN, KEYS, day, option_chain, r
from .registry import register

ENRICHED = f"""{CHAIN}, o AS (SELECT *, opt_prc/nullif(prc,0) AS p_ratio, delta*prc/nullif(opt_prc,0) AS elasticity, 0.2-iv AS rv_iv, volume AS v_ratio FROM chain)"""


def chain(spark, sf_dir):
    return N.contract_ratios(option_chain(spark, sf_dir), realized=F.lit(0.2)).withColumn("v_ratio", F.col("volume"))


PARTS = ("C", "P", "avg", "ratio", "spread1", "spread2")


def _sql(signal: str, weight: str, scale: str, digits: int) -> str:
    x = f"{signal}*{scale}" if scale else signal
    c, p = f"sum({x}*abs({weight})) FILTER (cp_flag='C')", f"sum({x}*abs({weight})) FILTER (cp_flag='P')"
    wc, wp, w = f"sum(abs({weight})) FILTER (cp_flag='C')", f"sum(abs({weight})) FILTER (cp_flag='P')", f"sum(abs({weight}))"
    return f"""{ENRICHED}, g AS (SELECT date, name, {c}/nullif({wc},0) AS c, {p}/nullif({wp},0) AS p, (coalesce({c},0)+coalesce({p},0))/nullif({w},0) AS a, (coalesce({c},0)-coalesce({p},0))/nullif({w},0) AS s2
 FROM o GROUP BY date, name HAVING count(*) FILTER (cp_flag='C')>0 AND count(*) FILTER (cp_flag='P')>0)
 SELECT {KEYS}, round(c,6) AS "{signal}_C", round(p,6) AS "{signal}_P", round(a,6) AS {signal}_avg, round(c/nullif(p,0),{digits}) AS {signal}_ratio, round(c-p,6) AS {signal}_spread1, round(s2,6) AS {signal}_spread2 FROM g"""


def _aggregate(key: str, signal: str, weight: str | None, annual: bool = False) -> None:
    """``annual``: the signal is a monthly volatility, to be shown a year; the ratio, which has no unit, with more digits."""
    digits = {p: 10 if annual and p == "ratio" else 6 for p in PARTS}

    @register(key, _sql(signal, weight or "1.0", "sqrt(12)" if annual else "", digits["ratio"]))
    def query(spark, sf_dir):
        df = chain(spark, sf_dir)
        df = df.withColumn(signal, F.col(signal) * math.sqrt(12)) if annual else df
        return O.aggregate(df, [signal], weight).select("name", day().alias("date"), *[r(f"{signal}_{p}", digits[p]).alias(f"{signal}_{p}") for p in PARTS])


_aggregate("d1_option_aggregate", "iv", None)
_aggregate("d2_price_ratio", "p_ratio", "volume")
_aggregate("d3_volume_ratio", "v_ratio", None)
_aggregate("d4_signed_volume", "volume", "delta")
_aggregate("d5_moneyness", "ks", "volume")
_aggregate("d6_expiry_days", "exdays", "volume")
_aggregate("d7_elasticity", "elasticity", "volume")
# in other units, means of two-digit values by whole weights would often lie half-way at the sixth digit
_aggregate("d8_implied_volatility", "iv", "volume", annual=True)
_aggregate("d10_rv_iv_spread", "rv_iv", "volume", annual=True)


@register("d9_iv_skew", f"""{ENRICHED}, g AS (SELECT date, name, ks<=1 AS low, sum(iv*volume) FILTER (cp_flag='C')/nullif(sum(volume) FILTER (cp_flag='C'),0) AS c, sum(iv*volume) FILTER (cp_flag='P')/nullif(sum(volume) FILTER (cp_flag='P'),0) AS p, sum(iv*volume)/nullif(sum(volume),0) AS a
 FROM o GROUP BY ALL HAVING count(*) FILTER (cp_flag='C')>0 AND count(*) FILTER (cp_flag='P')>0), w AS (SELECT date, name, max(c) FILTER (low) AS lc, max(p) FILTER (low) AS lp, max(a) FILTER (low) AS la, max(c) FILTER (NOT low) AS hc, max(p) FILTER (NOT low) AS hp, max(a) FILTER (NOT low) AS ha FROM g GROUP BY 1,2)
 SELECT {KEYS}, round(lc-hc,6) AS "skew_C_C", round(lc-hp,6) AS "skew_C_P", round(lp-hp,6) AS "skew_P_P", round(lp-hc,6) AS "skew_P_C", round(la-ha,6) AS skew_avg_avg FROM w""")
def d9(spark, sf_dir):
    out = O.skew(chain(spark, sf_dir), "iv", "ks", "volume")
    return out.select("name", day().alias("date"), *[r(c).alias(c) for c in out.columns if c.startswith("skew")])


CELL = ["date", "name", "cp_flag"]


@register("f9_select_by_max", f"{ENRICHED} SELECT {KEYS}, id FROM o QUALIFY row_number() OVER (PARTITION BY o.date, name, cp_flag ORDER BY volume DESC, strike DESC, id)=1")
def f9(spark, sf_dir):
    return O.select_by_max(chain(spark, sf_dir), "volume", "strike", CELL).select("name", day().alias("date"), "id")


@register("f10_select_option", f"{ENRICHED} SELECT {KEYS}, id FROM o QUALIFY rank() OVER (PARTITION BY o.date, name, cp_flag ORDER BY volume DESC, strike DESC, exdays DESC)=1")
def f10(spark, sf_dir):
    return O.select_option(chain(spark, sf_dir), "volume", "strike", "exdays", CELL).select("name", day().alias("date"), "id")


NEAREST = f"{ENRICHED}, n AS (SELECT * FROM o WHERE exdays >= 14 QUALIFY exdays = min(exdays) OVER (PARTITION BY o.date, name))"


@register("f11_select_calls", f"{NEAREST} SELECT {KEYS}, id FROM n WHERE strike >= prc*1.05 QUALIFY row_number() OVER (PARTITION BY n.date, name ORDER BY strike, id)=1")
def f11(spark, sf_dir):
    return O.select_calls(chain(spark, sf_dir), "prc", "strike", "exdays", 14, 0.05, ["date", "name"]).select("name", day().alias("date"), "id")


@register("f11_fixed_calls", f"""{NEAREST}, s AS (SELECT * FROM n WHERE strike >= prc*1.05 QUALIFY row_number() OVER (PARTITION BY n.date, name ORDER BY strike, id)=1),
 f AS (SELECT name, exdays, id FROM s QUALIFY row_number() OVER (PARTITION BY name, exdays ORDER BY s.date, id)=1) SELECT o.name, strftime(o.date,'%Y-%m-%d') AS date, o.id FROM o JOIN f ON o.name=f.name AND o.exdays=f.exdays AND o.id=f.id""")
def f11_fixed(spark, sf_dir):
    df = chain(spark, sf_dir)
    chosen = O.select_calls(df, "prc", "strike", "exdays", 14, 0.05, ["date", "name"])
    return O.fixed_contracts(chosen, df, "exdays").select("name", day().alias("date"), "id")


@register("f12_select_puts", f"{NEAREST} SELECT {KEYS}, id FROM n WHERE strike <= prc*0.95 QUALIFY row_number() OVER (PARTITION BY n.date, name ORDER BY strike DESC, id)=1")
def f12(spark, sf_dir):
    return O.select_puts(chain(spark, sf_dir), "prc", "strike", "exdays", 14, 0.05, ["date", "name"]).select("name", day().alias("date"), "id")


@register("f14_elasticity_pick", f"{ENRICHED} SELECT {KEYS}, id FROM o WHERE elasticity >= 2 QUALIFY row_number() OVER (PARTITION BY o.date ORDER BY elasticity, id)=1")
def f14(spark, sf_dir):
    return O.elasticity_pick(chain(spark, sf_dir).drop("elasticity"), ratio(F.col("delta") * F.col("prc"), F.col("opt_prc")), 2.0, ["date"]).select("name", day().alias("date"), "id")


@register("c12_contract_series", f"{ENRICHED}, t AS (SELECT date, id FROM o QUALIFY row_number() OVER (PARTITION BY o.date, name ORDER BY volume DESC, strike DESC, id)=1) SELECT {KEYS.replace('name', 'o.name').replace('date,', 'o.date,', 1)}, o.id, round(opt_prc,8) AS opt_prc FROM o JOIN t ON o.date=t.date AND o.id=t.id")
def c12(spark, sf_dir):
    df = chain(spark, sf_dir)
    chosen = O.select_by_max(df, "volume", "strike", ["date", "name"]).select("date", "id")
    return df.join(chosen, ["date", "id"]).select("name", day().alias("date"), "id", r("opt_prc", 8).alias("opt_prc"))


@register("b14_price_columns", f"{ENRICHED} SELECT {KEYS}, id, round(ks,6) AS ks, round(p_ratio,6) AS p_ratio, round(elasticity,4) AS elasticity, round(rv_iv,6) AS rv_iv FROM o")
def b14(spark, sf_dir):
    return chain(spark, sf_dir).select("name", day().alias("date"), "id", r("ks").alias("ks"), r("p_ratio").alias("p_ratio"), r("elasticity", 4).alias("elasticity"), r("rv_iv").alias("rv_iv"))


@register("b29_side_spread", f"""{ENRICHED}, g AS (SELECT date, name, sum(volume) FILTER (cp_flag='C') AS c, sum(volume) FILTER (cp_flag='P') AS p FROM o GROUP BY 1,2) SELECT {KEYS}, round(c+p,6) AS total, round((c+p)/nullif(c-p,0),6) AS spread FROM g WHERE c IS NOT NULL AND p IS NOT NULL""")
def b29(spark, sf_dir):
    return N.side_spread(chain(spark, sf_dir), "volume").select("name", day().alias("date"), r("total").alias("total"), r("spread").alias("spread"))

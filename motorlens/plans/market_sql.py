"""DuckDB SQL of the market chain, written independently of the DataFrame code, over the fixture listings."""

from __future__ import annotations

from motorlens import schemas as s
from motorlens.functions import vocab as _v
from motorlens.sources.fixtures import AS_OF, DUCK, SENTENCES

Y = AS_OF[:4]


def _map(table: dict, key: str, default: float) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default}::DOUBLE END"


_premium = ", ".join(f"'{m}'" for m in s.PREMIUM_MAKES)
AGE = f"CASE WHEN coalesce(year, 0) <> 0 THEN greatest(0::DOUBLE, {Y} - year + 0.5::DOUBLE) END"
FACTOR = (
    f"coalesce(greatest(0.05::DOUBLE, power(1 - ((CASE WHEN make IN ({_premium}) THEN 0.155::DOUBLE ELSE 0.125::DOUBLE END) + CASE WHEN fuel = 'electric' THEN 0.03::DOUBLE ELSE 0 END), greatest({AGE}, 0))), 1)"
    f" * coalesce(greatest(0.05::DOUBLE, power(1 - {_map(s.KM_RATE, 'fuel', 0.35)}, greatest(km, 0) / 150000::DOUBLE)), 1)"
    f" * (1 + least(options_n * 0.01::DOUBLE, 0.09::DOUBLE)) * (CASE WHEN gearbox = 'automatic' THEN 1.05::DOUBLE ELSE 1 END)"
    f" * {_map(s.SELLER_FACTOR, 'seller_type', 1.03)} * {_map(s.COUNTRY_FACTOR, 'country', 1.0)}"
)


def _admits(t: s.Tier) -> str:
    ok = f"abs(c.year - t.year) <= {t.years} AND c.km BETWEEN trunc(t.km * (1 - {t.km}::DOUBLE))::INT AND trunc(t.km * (1 + {t.km}::DOUBLE))::INT + {s.KM_SLACK}"
    return ok + (" AND c.fuel = t.fuel" if t.fuel else "") + (" AND c.gearbox = t.gearbox" if t.gearbox else "") + (" AND c.country = t.country" if t.country else "")


_tier_case = "CASE " + " ".join(f"WHEN {_admits(t)} THEN {k}" for k, t in enumerate(s.TIERS, 1)) + " END"
_names = "CASE tier_no " + " ".join(f"WHEN {k} THEN '{t.name}'" for k, t in enumerate(s.TIERS, 1)) + " END"
_weights = "CASE tier_no " + " ".join(f"WHEN {k} THEN {t.confidence}::DOUBLE" for k, t in enumerate(s.TIERS, 1)) + " END"

CHAIN = (
    DUCK
    + f""",
m AS (SELECT *, {FACTOR} AS factor, {AGE} AS age FROM listings),
p AS (SELECT * FROM (SELECT t.id AS tid, t.factor AS tf, t.km AS tkm, t.year AS tyear, c.id AS cid, c.fingerprint AS car, c.price_eur AS price, c.factor AS cf, c.km AS ckm, c.year AS cyear, c.age AS cage, c.country AS ccountry,
        {_tier_case} AS tier
      FROM m t JOIN m c ON t.make = c.make AND t.model = c.model AND t.is_synthetic = c.is_synthetic
      WHERE t.price_eur IS NOT NULL AND c.price_eur > {s.MIN_PRICE} AND c.seen_days <= {s.MAX_AGE_DAYS} AND t.id <> c.id AND t.fingerprint <> c.fingerprint) WHERE tier IS NOT NULL),
k AS (SELECT tid, car, min(tier) AS ft FROM p GROUP BY ALL),
n AS (SELECT tid, count(*) FILTER (ft <= 1) AS n1, count(*) FILTER (ft <= 2) AS n2, count(*) FILTER (ft <= 3) AS n3, count(*) FILTER (ft <= 4) AS n4, count(*) AS n5 FROM k GROUP BY tid),
ch AS (SELECT *, CASE WHEN n1 >= {s.MIN_COMPS} THEN 1 WHEN n2 >= {s.MIN_COMPS} THEN 2 WHEN n3 >= {s.MIN_COMPS} THEN 3 WHEN n4 >= {s.MIN_COMPS} THEN 4 WHEN n5 >= {s.MIN_COMPS} THEN 5
      WHEN n1 = n5 THEN 1 WHEN n2 = n5 THEN 2 WHEN n3 = n5 THEN 3 WHEN n4 = n5 THEN 4 ELSE 5 END AS tier_no FROM n),
c AS (SELECT * EXCLUDE (rn) FROM (SELECT p.*, tier_no, row_number() OVER (PARTITION BY p.tid, car ORDER BY price, cid) AS rn FROM p JOIN ch USING (tid) WHERE p.tier <= tier_no) WHERE rn = 1),
a AS (SELECT *, price * tf / cf AS adj, median(price * tf / cf) OVER (PARTITION BY tid) AS raw FROM c),
f0 AS (SELECT tid, count(*) AS cnt, avg(cage) AS m1, avg(ckm / 150000::DOUBLE) AS m2, avg(ln(price)) AS my,
      var_pop(cage) AS v1, var_pop(ckm / 150000::DOUBLE) AS v2, covar_pop(cage, ckm / 150000::DOUBLE) AS v12, covar_pop(cage, ln(price)) AS v1y, covar_pop(ckm / 150000::DOUBLE, ln(price)) AS v2y FROM c WHERE price > {s.MIN_PRICE} GROUP BY tid),
f1 AS (SELECT tid, CASE WHEN cnt >= 12 AND (v1 * v2 - v12 * v12) * cnt * cnt > 1e-9 * greatest(v1 * v2 * cnt * cnt, 1e-9) THEN v1 * v2 - v12 * v12 END AS det, v1, v2, v12, v1y, v2y FROM f0),
f2 AS (SELECT tid, (v2 * v1y - v12 * v2y) / det AS b, (v1 * v2y - v12 * v1y) / det AS cc FROM f1),
f AS (SELECT tid, CASE WHEN b < 0 AND cc < 0 THEN 1 - exp(b) END AS a_rate, CASE WHEN b < 0 AND cc < 0 THEN 1 - exp(cc) END AS k_rate FROM f2),
g AS (SELECT a.*, a_rate, k_rate, abs(adj - raw) AS dev,
      CASE WHEN a_rate > 0 AND a_rate < 0.5 AND k_rate > 0 AND k_rate < 0.8 THEN power(1 - a_rate, cage) * power(1 - k_rate, ckm / 150000::DOUBLE) END AS curve FROM a LEFT JOIN f USING (tid)),
v0 AS (SELECT tid, any_value(tier_no) AS tier_no, count(*) AS comps, any_value(raw) AS raw, median(dev) AS mad, min(adj) AS lo, max(adj) AS hi, median(CASE WHEN curve > 0.01 THEN price / curve END) AS implied,
      any_value(a_rate) AS a_rate, any_value(k_rate) AS k_rate, any_value(tkm) AS tkm, any_value(tyear) AS tyear, min(ckm) AS klo, max(ckm) AS khi, min(cyear) AS ylo, max(cyear) AS yhi FROM g GROUP BY tid),
v1 AS (SELECT *, implied * power(1 - a_rate, greatest(0, {Y} - tyear + 0.5::DOUBLE)) * power(1 - k_rate, tkm / 150000::DOUBLE) AS fitted, CASE WHEN comps < 3 THEN hi - lo ELSE 1.4826::DOUBLE * mad END AS disp FROM v0),
v2 AS (SELECT *, coalesce(fitted BETWEEN 0.5::DOUBLE * raw AND 1.8::DOUBLE * raw, false) AS mixed FROM v1),
v3 AS (SELECT *, CASE WHEN mixed THEN (raw + fitted) / 2 ELSE raw END AS centre, {_names} AS tier_name, {_weights} AS weight,
      CASE WHEN tkm < klo THEN least(0.5::DOUBLE, (klo - tkm) / greatest(khi, 1)::DOUBLE) WHEN tkm > khi THEN least(0.5::DOUBLE, (tkm - khi) / greatest(khi, 1)::DOUBLE) ELSE 0 END
      + CASE WHEN tyear < ylo OR tyear > yhi THEN 0.2::DOUBLE ELSE 0 END AS far FROM v2),
v4 AS (SELECT *, least(1, greatest(0, (0.45::DOUBLE * least(1, comps / 12::DOUBLE) + 0.30::DOUBLE * least(1, greatest(0, 1 - disp / centre / 0.28::DOUBLE)) + 0.25::DOUBLE * greatest(0, 1 - far)) * weight)) AS conf, greatest(disp, 0.04::DOUBLE * centre) AS spread FROM v3),
val AS (SELECT m.*, coalesce(tier_no, 0) AS tier_no, coalesce(comps, 0)::INT AS comps_count, coalesce(tier_name, 'aucun') AS tier, coalesce((CASE WHEN mixed THEN 'mixte:' ELSE 'comparables:' END) || tier_name, 'aucune_reference') AS method,
      coalesce(round(conf, 3), 0) AS confidence, round(coalesce(centre, price_eur), 2) AS fair_price_eur, round(CASE WHEN centre IS NULL THEN price_eur ELSE greatest(0, centre - spread) END, 2) AS low_eur, round(coalesce(centre + spread, price_eur), 2) AS high_eur,
      round(coalesce(centre - price_eur, 0), 2) AS delta_eur, round(coalesce((centre - price_eur) / centre, 0), 4) AS delta_pct, raw, disp, fitted, a_rate, k_rate
      FROM m LEFT JOIN v4 ON m.id = v4.tid WHERE m.price_eur IS NOT NULL)
"""
)

_known = {r[0]: ("risk", r[1], r[2], r[3], r[4], k) for k, r in enumerate(_v.RISKS)} | {r[0]: ("positive", r[1], r[2], r[3], r[4], 100 + k) for k, r in enumerate(_v.POSITIVES)}
_q = lambda x: x.replace("'", "''")
#: What the wording of each fixture sentence says, as rows; the truth comes from the fixture, not from a parser.
SAID = "said(sentence, code, polarity, label, weight, category, cost, turn) AS (VALUES " + ", ".join(f"({i}, '{c}', '{_known[c][0]}', '{_q(_known[c][1])}', {_known[c][2]}::DOUBLE, '{_known[c][3]}', {_known[c][4]}, {_known[c][5]})" for i, (_, codes) in enumerate(SENTENCES) for c in codes) + ")"

#: Expert report and score over `val`; terms are added in the order of the engine's rules.
SCORE = (
    CHAIN
    + ", "
    + SAID
    + f""",
sg AS (SELECT sentence, count(*) FILTER (polarity = 'risk' AND weight >= 0.6) AS heavy, count(*) FILTER (polarity = 'risk' AND weight < 0.6) AS light, count(*) FILTER (polarity = 'positive') AS good,
      coalesce(sum(cost) FILTER (polarity = 'risk'), 0)::INT AS cost, coalesce(max(weight) FILTER (polarity = 'risk'), 0) AS worst, bool_or(code = 'km_non_garanti') AS no_km,
      coalesce(sum(CASE WHEN polarity <> 'risk' THEN 0 WHEN weight >= 0.85 THEN 60 WHEN weight >= 0.6 THEN 30 WHEN weight >= 0.3 THEN 12 ELSE 3 END), 0)::INT AS points FROM said GROUP BY sentence),
df AS (SELECT id, list_filter([CASE WHEN fuel IN ('electric', 'phev') AND year BETWEEN 2011 AND 2030 THEN 'ev_sante_batterie' END, CASE WHEN fuel = 'diesel' AND year BETWEEN 2009 AND 2030 AND km / age <= 12000 AND age >= 0.5 THEN 'fap_trajets_courts' END,
        CASE WHEN make = 'Renault' AND model LIKE 'Zoe%' AND year BETWEEN 2012 AND 2022 THEN 'zoe_batterie_location' END, CASE WHEN make = 'Tesla' AND year BETWEEN 2017 AND 2021 THEN 'tesla_m3_suspension' END], lambda x: x IS NOT NULL) AS codes FROM m),
r0 AS (SELECT val.*, coalesce(heavy, 0) AS heavy, coalesce(light, 0) AS light, coalesce(good, 0) AS good, coalesce(cost, 0) AS cost, coalesce(worst, 0) AS worst, coalesce(no_km, false) AS no_km, coalesce(points, 0) AS points,
      CASE WHEN age >= 0.5 THEN km / age END AS kmy, delta_pct * 100 AS pct FROM val LEFT JOIN sg USING (sentence)),
r1 AS (SELECT *, pct > 22 AND heavy + light = 0 AS unexplained FROM r0),
r2 AS (SELECT *, heavy + light + unexplained::INT + coalesce(kmy > 32000, false)::INT AS n_flags, points + 12 * (unexplained::INT + coalesce(kmy > 32000, false)::INT) AS flag_points,
      greatest(0, least(100, 70 - 12 * heavy - 6 * light + least(20, 6 * good))) AS condition_score, greatest(0, least(100, 80 - 20 * unexplained::INT - 15 * no_km::INT)) AS consistency_score,
      CASE WHEN worst >= 0.85 THEN 'avoid' WHEN pct > 12 AND heavy = 0 THEN 'grab' ELSE 'check' END AS expert_verdict FROM r1),
r AS (SELECT *, cost AS repairs_eur, greatest(0, least(100, flag_points + greatest(0, 60 - consistency_score) // 2)) AS risk_score FROM r2),
t AS (SELECT *, CASE WHEN comps_count > 0 THEN greatest(-40, least(45, pct * 1.7::DOUBLE)) * (0.35::DOUBLE + 0.65::DOUBLE * confidence) ELSE -5 END AS p1, -0.45::DOUBLE * risk_score AS p2,
      (condition_score - 60) * 0.25::DOUBLE AS p3, (consistency_score - 70) * 0.22::DOUBLE AS p4, CASE WHEN repairs_eur > 0 THEN -least(28, repairs_eur / greatest(price_eur, 1) * 90::DOUBLE) END AS p5,
      CASE expert_verdict WHEN 'grab' THEN 8 WHEN 'avoid' THEN -20 END AS p6, CASE WHEN id % 9 = 0 THEN 5 END AS p7, CASE WHEN photos_n BETWEEN 1 AND 3 THEN -4 END AS p8, CASE WHEN photos_n >= 10 THEN 2 END AS p9,
      CASE WHEN seller_type = 'private' THEN 2 END AS p10, CASE WHEN kmy > 30000 THEN -4 END AS p11, CASE WHEN kmy > 0 AND kmy < 6000 AND age > 4 THEN -3 END AS p12 FROM r),
u AS (SELECT *, 50::DOUBLE + (0::DOUBLE + p1 + CASE WHEN risk_score > 0 THEN p2 ELSE 0 END + p3 + p4 + coalesce(p5, 0) + coalesce(p6, 0) + coalesce(p7, 0) + coalesce(p8, 0) + coalesce(p9, 0) + coalesce(p10, 0) + coalesce(p11, 0) + coalesce(p12, 0)) AS total,
      4 - 1 + (risk_score > 0)::INT + (p5 IS NOT NULL)::INT + (p6 IS NOT NULL)::INT + (p7 IS NOT NULL)::INT + (p8 IS NOT NULL)::INT + (p9 IS NOT NULL)::INT + (p10 IS NOT NULL)::INT + (p11 IS NOT NULL)::INT + (p12 IS NOT NULL)::INT AS n_factors FROM t),
scored AS (SELECT *, round_even(greatest(0, least(100, total)), 0)::INT AS score, delta_eur - repairs_eur AS net_gain_eur, NOT (comps_count > 0) OR confidence < {s.MIN_CONFIDENCE} AS thin FROM u),
deal AS (SELECT *, CASE WHEN expert_verdict = 'avoid' THEN 'avoid' WHEN thin THEN 'unknown' WHEN score >= {s.GREAT} THEN 'grab' WHEN score >= {s.CHECK} THEN 'check' ELSE 'avoid' END AS verdict,
      replace(format('{{:,}}', round_even(net_gain_eur, 0)::BIGINT), ',', chr(8239)) AS gain FROM scored)
"""
)
HEADLINE = """CASE WHEN thin AND comps_count > 0 THEN 'Seulement ' || comps_count || CASE WHEN comps_count > 1 THEN ' references comparables' ELSE ' reference comparable' END || ': prix non jugeable'
  WHEN thin THEN 'Pas assez de references pour juger le prix' WHEN score >= 80 THEN 'Affaire serieuse: environ ' || gain || ' EUR de gain net estime'
  WHEN score >= 65 THEN 'Interessant, sous reserve de verification (gain estime ' || gain || ' EUR)' WHEN score >= 45 THEN 'Prix coherent avec le marche, rien d''exceptionnel'
  WHEN net_gain_eur > 0 THEN 'Bon marche, mais les risques annulent l''economie' ELSE 'Au-dessus du marche pour ce qu''il propose' END"""
BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, price_eur, id) AS rn, (count(*) OVER (PARTITION BY fingerprint) - 1)::INT AS others, greatest(0, max(price_eur) OVER (PARTITION BY fingerprint) - price_eur) AS spread_eur FROM deal WHERE active) WHERE rn = 1)"

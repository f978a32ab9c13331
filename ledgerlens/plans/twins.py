"""DuckDB twins of the catalog's queries."""

from __future__ import annotations

import re

from .views import WITH, WITH_LEDGER

SCORE_LISTS = {
    "behavioral_score": ["incoming_volume", "outgoing_volume", "net_balance_ratio", "velocity_score", "receive_to_send_delay_hours", "burst_index", "dormancy_score", "incoming_counterparty_diversity", "outgoing_counterparty_diversity", "repeat_transfer_ratio"],
    "structural_score": ["in_degree", "out_degree", "degree_ratio"],
    "propagation_score": ["funnel_score", "risk_propagation_score", "device_cluster_score"],
}


def side(me: str, other: str, word: str, t: str = "p2p") -> str:
    return f"""SELECT {me} AS account_id, CAST(sum(CAST(amount AS DECIMAL(28,2))) AS DOUBLE) AS {word}_volume,
  CAST(sum(CAST(amount AS DECIMAL(28,2))) AS DOUBLE) / count(amount) AS avg_{word}_amount, max(amount) AS max_{word}_amount,
  count(*) AS {word}_txn_count, count(DISTINCT {other}) AS {word}_counterparty_diversity FROM {t} GROUP BY {me}"""


def gaps(t: str) -> str:
    return f"""SELECT account_id, coalesce(stddev_samp(gap) / (avg(gap) + 1e-8), 0) AS burst_index,
  coalesce(max(gap) / (((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000) + 1e-8), 0) AS dormancy_score
FROM (SELECT account_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account_id ORDER BY ts))) // 1000000 AS gap
      FROM (SELECT sender_id AS account_id, "timestamp" AS ts FROM {t} UNION ALL SELECT receiver_id, "timestamp" FROM {t}) u) g GROUP BY account_id"""


DELAY = """SELECT account_id, coalesce(greatest((epoch_us(fo) - epoch_us(li)) // 1000000, 0) / 3600.0, 0) AS receive_to_send_delay_hours
FROM (SELECT receiver_id AS account_id, max("timestamp") AS li FROM p2p GROUP BY 1) a FULL JOIN (SELECT sender_id AS account_id, min("timestamp") AS fo FROM p2p GROUP BY 1) b USING (account_id)"""

REPEAT = """SELECT sender_id AS account_id, coalesce(sum(CASE WHEN n > 1 THEN n END), 0) / (sum(n) + 1e-8) AS repeat_transfer_ratio
FROM (SELECT sender_id, receiver_id, count(*) AS n FROM p2p GROUP BY ALL) x GROUP BY sender_id"""

INC, OUT = side("receiver_id", "sender_id", "incoming"), side("sender_id", "receiver_id", "outgoing")

EDGES = """SELECT {k}sender_id AS src, receiver_id AS dst, CAST(sum(CAST(amount AS DECIMAL(28,2))) AS DOUBLE) AS weight, count(*) AS frequency, min(amount) AS min_amount, max(amount) AS max_amount,
  min("timestamp") AS first_txn, max("timestamp") AS last_txn, CAST(sum(CAST(amount AS DECIMAL(28,2))) AS DOUBLE) / count(*) AS avg_amount,
  CASE WHEN count(*) > 1 AND min("timestamp") <> max("timestamp") THEN (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6 / (count(*) - 1) ELSE 0 END AS avg_inter_txn_gap
FROM {t} GROUP BY ALL"""

BEH = """SELECT account_id, {cols} FROM inc FULL JOIN outg USING (account_id) LEFT JOIN delay USING (account_id) LEFT JOIN gap USING (account_id) LEFT JOIN rep USING (account_id)"""
_SIDES = [f"{p}{w}{s}" for w in ("incoming", "outgoing") for p, s in (("", "_volume"), ("avg_", "_amount"), ("max_", "_amount"), ("", "_txn_count"), ("", "_counterparty_diversity"))]
_DOUBLE = [c for c in _SIDES if not c.endswith(("count", "diversity"))]
BEH = BEH.format(
    cols=", ".join([f"round(coalesce({c}, 0), 6) AS {c}" if c in _DOUBLE else f"coalesce({c}, 0) AS {c}" for c in _SIDES])
    + ", round(coalesce((incoming_volume - outgoing_volume) / (incoming_volume + outgoing_volume + 1e-8), 0), 6) AS net_balance_ratio, round(coalesce(outgoing_volume / (incoming_volume + 1e-8), 0), 6) AS velocity_score"
    + "".join(f", round(coalesce({c}, 0), 6) AS {c}" for c in ("receive_to_send_delay_hours", "burst_index", "dormancy_score", "repeat_transfer_ratio"))
)

DEGREE = """SELECT v.account_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS total_degree,
  round(coalesce(wi, 0), 6) AS weighted_in_degree, round(coalesce(wo, 0), 6) AS weighted_out_degree, round(CASE WHEN coalesce(i, 0) > 0 THEN coalesce(o, 0) / i ELSE coalesce(o, 0) END, 6) AS degree_ratio
FROM vert v LEFT JOIN (SELECT dst AS account_id, count(*) AS i, CAST(sum(CAST(weight AS DECIMAL(28,2))) AS DOUBLE) AS wi FROM edge GROUP BY 1) a USING (account_id)
LEFT JOIN (SELECT src AS account_id, count(*) AS o, CAST(sum(CAST(weight AS DECIMAL(28,2))) AS DOUBLE) AS wo FROM edge GROUP BY 1) b USING (account_id)"""

VERT = """SELECT account_id, coalesce(account_type, 'unknown') AS account_type, coalesce(kyc_level, 'unknown') AS kyc_level, coalesce(geographic_region, 'unknown') AS region,
  coalesce(is_fraud, false) AS is_fraud, coalesce(fraud_role, 'normal') AS fraud_role
FROM (SELECT src AS account_id FROM edge UNION SELECT dst FROM edge UNION SELECT account_id FROM accounts) i LEFT JOIN accounts USING (account_id)"""

FUNNEL = """SELECT account_id, round((CASE WHEN in_degree + out_degree > 0 THEN in_degree / (in_degree + out_degree) ELSE 0 END)
  * (CASE WHEN weighted_in_degree > 0 AND weighted_out_degree > 0 THEN least(weighted_in_degree, weighted_out_degree) / greatest(weighted_in_degree, weighted_out_degree) ELSE 0 END) * least(1.0, in_degree / 5), 6) AS funnel_score FROM deg"""

RISK = """SELECT v.account_id, CASE WHEN v.is_fraud THEN 1.0 ELSE round(least(1.0, coalesce(share, 0) + coalesce(flow, 0)), 6) END AS risk_propagation_score
FROM vert v LEFT JOIN (SELECT u AS account_id, sum(CASE WHEN f.is_fraud THEN 1 ELSE 0 END) / count(*) AS share
  FROM (SELECT src AS u, dst AS v FROM edge UNION SELECT dst, src FROM edge) n JOIN vert f ON f.account_id = n.v GROUP BY u) s USING (account_id)
LEFT JOIN (SELECT dst AS account_id, sum(CASE WHEN total > 0 THEN 0.3 * weight / total ELSE 0 END) AS flow FROM edge JOIN vert f ON f.account_id = src AND f.is_fraud
  JOIN (SELECT src, CAST(sum(CAST(weight AS DECIMAL(28,2))) AS DOUBLE) AS total FROM edge GROUP BY src) t USING (src) GROUP BY dst) w USING (account_id)"""

DEVICE = """SELECT account_id, round(coalesce(n / (SELECT max(n) FROM (SELECT count(*) AS n FROM accounts WHERE device_fingerprint_id IS NOT NULL GROUP BY device_fingerprint_id HAVING count(*) > 1)), 0), 6) AS device_cluster_score
FROM accounts LEFT JOIN (SELECT device_fingerprint_id, count(*) AS n FROM accounts WHERE device_fingerprint_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) USING (device_fingerprint_id)"""

BASE = f"{WITH}, edge AS ({EDGES.format(k='', t='p2p')}), vert AS ({VERT}), deg AS ({DEGREE})"
BEH_WITH = f"{WITH}, inc AS ({INC}), outg AS ({OUT}), delay AS ({DELAY}), gap AS ({gaps('p2p')}), rep AS ({REPEAT}), beh AS ({BEH})"
_BEH_COLS = [*_SIDES, "net_balance_ratio", "velocity_score", "receive_to_send_delay_hours", "burst_index", "dormancy_score", "repeat_transfer_ratio"]
FEATURES = f"""{BEH_WITH}, edge AS ({EDGES.format(k='', t='p2p')}), vert AS ({VERT}), deg AS ({DEGREE}), fun AS ({FUNNEL}), rsk AS ({RISK}), dev AS ({DEVICE}),
feat AS (SELECT deg.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _BEH_COLS)}, funnel_score, risk_propagation_score, coalesce(device_cluster_score, 0) AS device_cluster_score
  FROM deg LEFT JOIN beh USING (account_id) LEFT JOIN fun USING (account_id) LEFT JOIN rsk USING (account_id) LEFT JOIN dev USING (account_id))"""


def _component(name: str, cols: list[str]) -> str:
    z = " + ".join(f"({c} - quantile_cont({c}, 0.5) OVER ()) / CASE WHEN quantile_cont({c}, 0.75) OVER () = quantile_cont({c}, 0.25) OVER () THEN 1 ELSE quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER () END" for c in cols)
    return f"({z}) / {len(cols)} AS {name}"


_SCALED = ", ".join(f"CASE WHEN max({n}) OVER () - min({n}) OVER () > 1e-8 THEN round(({n} - min({n}) OVER ()) / (max({n}) OVER () - min({n}) OVER ()) * 100, 2) ELSE 0.0 END AS {n}" for n in SCORE_LISTS)
_BAND = "CASE WHEN {s} >= 90 THEN 'critical' WHEN {s} >= 75 THEN 'high' WHEN {s} >= 50 THEN 'medium' WHEN {s} >= 25 THEN 'low' ELSE 'minimal' END"
SCORES = f"""{FEATURES}, raw AS (SELECT account_id, {", ".join(_component(n, c) for n, c in SCORE_LISTS.items())} FROM feat),
comp AS (SELECT account_id, {_SCALED} FROM raw),
blend AS (SELECT *, round(least(greatest(1e-9 + (0.35 * behavioral_score + 0.35 * structural_score + 0.3 * propagation_score) / CAST(0.35 + 0.35 + 0.3 AS DOUBLE), 0), 100), 2) AS risk_score FROM comp),
scores AS (SELECT account_id, risk_score, behavioral_score, structural_score, propagation_score, {_BAND.format(s="risk_score")} AS risk_level FROM blend)"""

LABELLED = "WITH s AS (SELECT doc_id AS account_id, quality AS label, ((doc_id * 37 + quality * 400) % 1000) / 1000.0::DOUBLE AS score FROM labels)"
_CURVE = """, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM s GROUP BY score),
c AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM g), t AS (SELECT sum(label) AS t, sum(1 - label) AS f FROM s)"""

_W = _BEH_COLS
HALVES = f"""{BEH_WITH}, halves AS ({" UNION ALL ".join(f"SELECT account_id % 2 AS side, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM beh" for c in _W)})"""
ECDF = """, st AS (SELECT feature, value, sum(1 - side) AS a, sum(side) AS b FROM halves GROUP BY feature, value),
gp AS (SELECT feature, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY feature) - sum(b) OVER w / sum(b) OVER (PARTITION BY feature)) AS gap, coalesce(lead(value) OVER w - value, 0) AS dx
  FROM st WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, round(max(gap), 6) AS ks, round(sum(gap * dx), 6) AS wasserstein FROM gp GROUP BY feature)"""
PSI = """, sp AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM halves GROUP BY feature),
bn AS (SELECT feature, side, CASE WHEN hi - lo < 1e-10 THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 20), 19) END AS bin, hi - lo AS w FROM halves JOIN sp USING (feature)),
ct AS (SELECT feature, bin, sum(1 - side) AS a, sum(side) AS b FROM bn GROUP BY feature, bin), nn AS (SELECT feature, sum(1 - side) AS na, sum(side) AS nb, max(w) AS w FROM bn GROUP BY feature),
pq AS (SELECT feature, w, (coalesce(a, 0) + 1.0) / (na + 20) AS p, (coalesce(b, 0) + 1.0) / (nb + 20) AS q FROM (SELECT *, unnest(range(20)) AS bin FROM nn) x LEFT JOIN ct USING (feature, bin)),
psi AS (SELECT feature, CASE WHEN max(w) < 1e-10 THEN 0.0 ELSE round(sum((CAST(q AS DOUBLE) - CAST(p AS DOUBLE)) * ln(CAST(q AS DOUBLE) / CAST(p AS DOUBLE))), 6) END AS psi FROM pq GROUP BY feature)"""

_P_VALUE = """least(greatest(list_sum([2.0::DOUBLE * power(-1, k - 1) * exp(-2.0 * k * k * x * x) FOR k IN range(1, 21)]), 0), 1)"""
DRIFT = f"""{HALVES}{ECDF}{PSI}, mo AS (SELECT feature, avg(value) FILTER (side = 0) AS m0, stddev_pop(value) FILTER (side = 0) AS s0, count(value) FILTER (side = 0) AS n0,
  avg(value) FILTER (side = 1) AS m1, count(value) FILTER (side = 1) AS n1 FROM halves GROUP BY feature),
en AS (SELECT feature, ks, psi, wasserstein, round(abs(m1 - m0) / (s0 + 1e-8), 6) AS mean_shift, sqrt(n0 * n1 / CAST(n0 + n1 AS DOUBLE)) AS en FROM mo JOIN ks USING (feature) JOIN psi USING (feature)),
pv AS (SELECT *, (en + 0.12 + 0.11 / en) * ks AS x FROM en),
dr AS (SELECT feature, mean_shift, ks, psi, wasserstein, round(CASE WHEN x < 0.2 THEN 1.0 ELSE {_P_VALUE} END, 6) AS p_value FROM pv),
fd AS (SELECT *, p_value < 0.05 OR mean_shift > 2 OR psi > 0.2 AS drifted FROM dr)"""

POWER = """, hs AS (SELECT degree, count(*) AS n FROM (SELECT count(*) AS degree FROM p2p GROUP BY sender_id UNION ALL SELECT count(*) FROM p2p GROUP BY receiver_id) GROUP BY degree),
al AS (SELECT a.degree AS x, sum(b.n) AS total, 1 + sum(b.n) / sum(b.n * ln(b.degree / (a.degree - 0.5::DOUBLE))) AS alpha FROM hs a JOIN hs b ON b.degree >= a.degree GROUP BY a.degree HAVING sum(b.n) >= 10 AND count(*) > 1),
cu AS (SELECT x, alpha, degree, sum(n) OVER (PARTITION BY x ORDER BY degree) / total AS seen FROM al JOIN hs ON degree >= x),
ga AS (SELECT x, alpha, max(abs(seen - (1 - power(degree + 0.5::DOUBLE, 1 - alpha) / power(x - 0.5::DOUBLE, 1 - alpha)))) AS gap FROM cu GROUP BY x, alpha),
pw AS (SELECT alpha, x AS xmin, alpha > 1.5 AND alpha < 4 AS passed FROM ga ORDER BY gap, alpha, x LIMIT 1)"""

CLUSTER = """, pr AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edge WHERE src <> dst), nb AS (SELECT u, v FROM pr UNION ALL SELECT v, u FROM pr),
tri AS (SELECT a.u AS account_id, count(*) / 2 AS t FROM nb a JOIN nb b ON a.u = b.u AND a.v <> b.v JOIN nb c ON c.u = a.v AND c.v = b.v GROUP BY a.u), dg AS (SELECT u AS account_id, count(*) AS d FROM nb GROUP BY u),
clu AS (SELECT account_id, round(coalesce(CASE WHEN d >= 2 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) END, 0), 6) AS clustering_coefficient FROM vert LEFT JOIN dg USING (account_id) LEFT JOIN tri USING (account_id))"""


def _graph_row(deg: str) -> str:
    return f"""SELECT count(*) AS n_vertices, CAST(sum(in_degree) AS BIGINT) AS n_edges, round(CASE WHEN count(*) > 1 THEN sum(in_degree) / (count(*) * (count(*) - 1)) ELSE 0 END, 6) AS density, round(avg(in_degree), 6) AS avg_in_degree, max(in_degree) AS max_in_degree,
  round(avg(out_degree), 6) AS avg_out_degree, max(out_degree) AS max_out_degree, round(avg(CASE WHEN out_degree = 0 THEN 1 ELSE 0 END), 6) AS leaf_ratio, round(avg(CASE WHEN in_degree = 0 THEN 1 ELSE 0 END), 6) AS root_ratio,
  sqrt(greatest(sum(in_degree * in_degree + out_degree * out_degree) / (2.0 * count(*)) - (sum(in_degree) / count(*)) * (sum(in_degree) / count(*)), 0)) AS sd FROM {deg}"""


_HALF_GRAPH = ", ".join(
    f"e{k} AS (SELECT DISTINCT sender_id AS src, receiver_id AS dst FROM p2p WHERE transaction_id % 2 = {k}), "
    f"d{k} AS (SELECT account_id, (SELECT count(*) FROM e{k} WHERE dst = account_id) AS in_degree, (SELECT count(*) FROM e{k} WHERE src = account_id) AS out_degree FROM (SELECT src AS account_id FROM e{k} UNION SELECT dst FROM e{k})), m{k} AS ({_graph_row(f'd{k}')})"
    for k in (0, 1)
)
_GM = ["n_vertices", "n_edges", "density", "avg_in_degree", "max_in_degree", "avg_out_degree", "max_out_degree", "leaf_ratio", "root_ratio"]
_GP = ["degree_std", "avg_clustering", "n_scc", "largest_scc_ratio", "n_wcc"]


def _components(k: str, edge: str, ids: str) -> str:
    """pt: strong and weak components of a graph by plain reachability."""
    return f"""ar{k} AS (SELECT DISTINCT src, dst FROM {edge} WHERE src <> dst), rc{k} AS (SELECT src AS a, dst AS b FROM ar{k} UNION SELECT rc{k}.a, ar{k}.dst FROM rc{k} JOIN ar{k} ON rc{k}.b = ar{k}.src),
  mu{k} AS (SELECT x.a, x.b FROM rc{k} x JOIN rc{k} y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b), ss{k} AS (SELECT account_id, 1 + count(b) AS n FROM {ids} LEFT JOIN mu{k} ON a = account_id GROUP BY account_id),
  un{k} AS (SELECT src AS u, dst AS v FROM ar{k} UNION SELECT dst, src FROM ar{k}), wc{k} AS (SELECT account_id AS a, account_id AS b FROM {ids} UNION SELECT wc{k}.a, un{k}.v FROM wc{k} JOIN un{k} ON wc{k}.b = un{k}.u),
  pt{k} AS (SELECT (SELECT CAST(round(sum(1.0 / n)) AS BIGINT) FROM ss{k}) AS n_scc, (SELECT round(max(n) / count(*), 6) FROM ss{k}) AS largest_scc_ratio, (SELECT count(DISTINCT l) FROM (SELECT a, min(b) AS l FROM wc{k} GROUP BY a)) AS n_wcc)"""


def _metrics(k: str, edge: str, ids: str, row: str) -> str:
    """gm: all metrics of a graph, one row, from its row of degrees."""
    cluster = re.sub(r"\b(pr|nb|tri|dg|clu)\b", rf"\g<1>{k}", CLUSTER.lstrip(", "))
    cluster = re.sub(r"\bvert\b", ids, re.sub(r"\bedge\b", edge, cluster))
    return f"{cluster}, {_components(k, edge, ids)}, gm{k} AS (SELECT {', '.join(_GM)}, round(sd, 6) AS degree_std, (SELECT round(avg(clustering_coefficient), 6) FROM clu{k}) AS avg_clustering, n_scc, largest_scc_ratio, n_wcc FROM {row}, pt{k})"

SEQ = """, sd AS (SELECT transaction_id, amount, "timestamp" AS ts, sender_id AS account_id, 1 AS is_sender FROM ev UNION ALL SELECT transaction_id, amount, "timestamp", receiver_id, 0 FROM ev),
sr AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts, transaction_id, is_sender) AS pos,
  coalesce(least(greatest((epoch_us(date_trunc('second', ts)) - epoch_us(date_trunc('second', lag(ts) OVER (PARTITION BY account_id ORDER BY ts, transaction_id, is_sender)))) // 1000000 / 3600.0, 0), 720), 0) AS h FROM sd),
sk AS (SELECT *, ln(1 + amount) AS a FROM sr WHERE pos <= 200),
sq AS (SELECT account_id, pos, coalesce(CASE WHEN max(a) OVER w > 0 THEN a / max(a) OVER w END, 0) AS amount, CAST(is_sender AS DOUBLE) AS is_sender, hour(ts) / 23.0::DOUBLE AS hour, (isodow(ts) - 1) / 6.0::DOUBLE AS day,
  CASE WHEN max(h) OVER w > 0 THEN h / max(h) OVER w ELSE 0 END AS delta FROM sk WINDOW w AS (PARTITION BY account_id))"""


def _stat(c: str) -> str:
    return (
        f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max, "
        f"round(CASE WHEN count(*) > 2 AND stddev_pop({c}) > 1e-9 THEN sum(power({c} - mu_{c}, 3)) / count(*) / power(stddev_pop({c}), 3) END, 6) AS {c}_skew, round(CASE WHEN count(*) > 1 THEN regr_slope({c}, t) ELSE 0 END, 6) AS {c}_slope"
    )


_CH = ["amount", "is_sender", "hour", "day", "delta"]

MOVE = """, mv0 AS (SELECT dst AS i, src AS j, ln(1 + weight) * ln(1 + frequency) AS w FROM edge UNION ALL SELECT src, dst, 0.5 * (ln(1 + weight) * ln(1 + frequency)) FROM edge),
mv1 AS (SELECT i, j, sum(w) AS w FROM mv0 GROUP BY i, j), mv AS (SELECT i, j, w / CASE WHEN t = 0 THEN 1 ELSE t END AS w FROM mv1 JOIN (SELECT j, sum(w) AS t FROM mv1 GROUP BY j) USING (j))"""
_STEP = """, r{b} AS MATERIALIZED (SELECT account_id, seed, CASE WHEN seed THEN s ELSE least(greatest(greatest(0.5 * coalesce(g, 0), s), 0), 1) END AS s FROM r{a} LEFT JOIN (SELECT i, sum(w * s) AS g FROM mv JOIN r{a} ON j = account_id GROUP BY i) ON i = account_id)"""
_HOP = """, h{b} AS MATERIALIZED (SELECT account_id, min(dist) AS dist FROM (SELECT * FROM h{a} UNION ALL SELECT v, {b} FROM un JOIN h{a} ON u = account_id) GROUP BY account_id)"""
PROPAGATE = (
    f"{BASE}{MOVE}, r0 AS (SELECT account_id, is_fraud AS seed, CASE WHEN is_fraud THEN 1.0::DOUBLE ELSE 0 END AS s FROM vert){''.join(_STEP.format(a=k, b=k + 1) for k in range(20))}"
    ", un AS MATERIALIZED (SELECT src AS u, dst AS v FROM edge UNION SELECT dst, src FROM edge), h0 AS (SELECT account_id, 0 AS dist FROM r0 WHERE seed)"
    f"{''.join(_HOP.format(a=k, b=k + 1) for k in range(5))}"
    " SELECT account_id, round(CASE WHEN seed THEN s ELSE coalesce(s * power(0.5::DOUBLE, dist), 0) END, 6) AS advanced_propagation_score FROM r20 LEFT JOIN h5 USING (account_id)"
)
_RANK = """, rk{b} AS MATERIALIZED (SELECT account_id, 0.15 / n + 0.85 * (coalesce(g, 0) + loose / n) AS pr FROM vert CROSS JOIN (SELECT count(*) AS n FROM vert)
  CROSS JOIN (SELECT coalesce(sum(pr), 0) AS loose FROM rk{a} WHERE account_id NOT IN (SELECT src FROM edge)) LEFT JOIN (SELECT dst, sum(p * pr) AS g FROM tp JOIN rk{a} ON src = account_id GROUP BY dst) ON dst = account_id)"""
_ROLL = """, w{b} AS MATERIALIZED (SELECT walk, y AS x FROM (SELECT walk, x, (walk * 7919 + {c} + x * 31) % n AS i FROM w{a} JOIN (SELECT DISTINCT x, n FROM nr) USING (x)) JOIN nr USING (x, i))"""
WALKS = (
    f"{BASE}, nr AS MATERIALIZED (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY k, y) - 1 AS i, count(*) OVER (PARTITION BY x) AS n FROM (SELECT src AS x, dst AS y, 0 AS k FROM edge UNION ALL SELECT dst, src, 1 FROM edge))"
    f", w0 AS (SELECT account_id * 10 + r AS walk, account_id AS x FROM vert, (SELECT unnest(range(10)) AS r)){''.join(_ROLL.format(a=k - 1, b=k, c=k * 104729 + 42 * 15485863) for k in range(1, 40))}"
    f", wk AS ({' UNION ALL '.join(f'SELECT walk, {k} AS step, x AS vertex FROM w{k}' for k in range(40))})"
)
PAGERANK = (
    f"{BASE}, tp AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM edge), rk0 AS (SELECT account_id, 1.0::DOUBLE / (SELECT count(*) FROM vert) AS pr FROM vert)"
    f"{''.join(_RANK.format(a=k, b=k + 1) for k in range(30))} SELECT account_id, round(round(pr, 8) * 100, 6) AS pagerank FROM rk30"
)

def _differ(xs: list[str], ys: list[str]) -> str:
    return " AND ".join([f"{x} <> {y}" for x in xs for y in ys] or ["true"])


def _halves(bound: int) -> str:
    """f1, f2, ...: simple paths from s to m by inner vertices x1, x2, ...; b1, ...: from m to s by y1, ...; all above s."""
    out = ["f1 AS MATERIALIZED (SELECT src AS s, dst AS m FROM ar WHERE dst > src)", "b1 AS MATERIALIZED (SELECT dst AS s, src AS m FROM ar WHERE src > dst)"]
    for name, c, at, to, n in (("f", "x", "src", "dst", (bound + 1) // 2), ("b", "y", "dst", "src", bound // 2)):
        for k in range(1, n):
            inner = [f"{c}{i}" for i in range(1, k)]
            cols = "".join(f"{x}, " for x in inner)
            out.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT s, {cols}p.m AS {c}{k}, ar.{to} AS m FROM {name}{k} p JOIN ar ON p.m = ar.{at} "
                f"WHERE ar.{to} > s AND {_differ([f'ar.{to}'], ['p.m', *inner])})"
            )
    return ", ".join(out)


def _cycle(length: int) -> str:
    a, b = (length + 1) // 2, length // 2
    xs, ys = [f"x{i}" for i in range(1, a)], [f"y{i}" for i in range(1, b)]
    return f"SELECT [{', '.join(['s', *xs, 'm', *ys])}] AS p FROM f{a} JOIN b{b} USING (s, m) WHERE {_differ(xs, ys)}"


CYCLES = f""", ar AS MATERIALIZED (SELECT DISTINCT src, dst FROM edge), {_halves(8)}, cy AS (SELECT [src] AS p FROM ar WHERE src = dst
  UNION ALL {" UNION ALL ".join(map(_cycle, range(2, 9)))}),
hc AS (SELECT account_id, count(*) AS n FROM (SELECT unnest(p) AS account_id FROM cy) GROUP BY account_id)"""


def _layers(bound: int) -> str:
    """dp: accounts and the lengths k of simple paths to one of their direct successors."""
    out = ["u1 AS MATERIALIZED (SELECT src AS v, dst AS m FROM di)", "w0 AS MATERIALIZED (SELECT src AS v, dst AS m FROM di)"]
    for k in range(1, (bound + 1) // 2):
        inner = [f"x{i}" for i in range(1, k)]
        out.append(
            f"u{k + 1} AS MATERIALIZED (SELECT v, {''.join(f'{x}, ' for x in inner)}p.m AS x{k}, ar.dst AS m FROM u{k} p JOIN ar ON p.m = ar.src "
            f"WHERE {_differ(['ar.dst'], ['v', *inner])})"
        )
    for k in range(bound // 2):
        inner = [f"y{i}" for i in range(1, k + 1)]
        out.append(
            f"w{k + 1} AS MATERIALIZED (SELECT v, {''.join(f'{y}, ' for y in inner)}p.m AS y{k + 1}, ar.src AS m FROM w{k} p JOIN ar ON p.m = ar.dst "
            f"WHERE {_differ(['ar.src'], ['v', *inner])})"
        )
    met = ["SELECT src, 1 AS k FROM di"]
    for k in range(2, bound + 1):
        a, b = (k + 1) // 2, k // 2
        far = _differ([f"x{i}" for i in range(1, a)], [f"y{i}" for i in range(1, b + 1)])
        met.append(f"SELECT DISTINCT v, {k} FROM u{a} JOIN w{b} USING (v, m) WHERE {far}")
    return ", ".join(out) + f", dp AS ({' UNION ALL '.join(met)})"


LAYERS = (
    ", ar AS MATERIALIZED (SELECT DISTINCT src, dst FROM edge WHERE src <> dst), bo AS (SELECT src AS v FROM edge INTERSECT SELECT dst FROM edge), "
    "di AS (SELECT * FROM ar WHERE src IN (SELECT v FROM bo)), " + _layers(7)
)

#: Vertices within three hops of vertex 7, by number of hops.
EGO = f"""{BASE}, un AS (SELECT src AS u, dst AS v FROM edge WHERE src <> dst UNION SELECT dst, src FROM edge WHERE src <> dst), h1 AS (SELECT DISTINCT v FROM un WHERE u = 7),
h2 AS (SELECT DISTINCT un.v FROM h1 JOIN un ON h1.v = un.u), h3 AS (SELECT DISTINCT un.v FROM h2 JOIN un ON h2.v = un.u),
h AS (SELECT CAST(7 AS BIGINT) AS a, 0 AS d UNION ALL SELECT v, 1 FROM h1 UNION ALL SELECT v, 2 FROM h2 UNION ALL SELECT v, 3 FROM h3)"""

#: The omnibus normality test, each step a table of its own.
_K2 = (
    "skew * sqrt((n + 1) * (n + 3) / (6.0::DOUBLE * (n - 2))) AS y, 3.0::DOUBLE * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0::DOUBLE) * (n + 5) * (n + 7) * (n + 9)) AS b2",
    "sqrt(2 * (b2 - 1)) - 1 AS w2, (kurt + 3 - 3.0::DOUBLE * (n - 1) / (n + 1)) / sqrt(24.0::DOUBLE * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, "
    "6.0::DOUBLE * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0::DOUBLE * (n + 3) * (n + 5) / (n * (n - 2.0::DOUBLE) * (n - 3))) AS root",
    "asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a",
    "(1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS t",
    "(1 - 2 / (9 * a) - sign(t) * power(abs(t), 1.0::DOUBLE / 3)) / sqrt(2 / (9 * a)) AS z2",
    "z1 * z1 + z2 * z2 AS k2",
)
LOGNORMALITY = (
    f"{WITH}, x AS (SELECT ln(amount) AS x FROM p2p WHERE amount > 0), m AS (SELECT count(*) AS m, avg(x) AS mu, stddev_pop(x) AS sd FROM x), "
    "k0 AS (SELECT any_value(m) AS m, CAST(any_value(m) AS DOUBLE) AS n, any_value(mu) AS mu, any_value(sd) AS sd, avg(power((x - mu) / sd, 3)) AS skew, avg(power((x - mu) / sd, 4)) - 3 AS kurt FROM x, m), "
    + ", ".join(f"k{i + 1} AS (SELECT *, {step} FROM k{i})" for i, step in enumerate(_K2))
    + " SELECT m AS n, round(mu, 6) AS log_mean, round(sd, 6) AS log_std, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(k2, 3) AS k2, round(exp(-k2 / 2), 6) AS p_value, m >= 8 AND sd > 0.5 AND mu > 0 AS passed FROM k6"
)

TOP = "SELECT account_id, rank, feature, value FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(value) DESC, feature) AS rank FROM lf) WHERE rank <= 5"
_FEATS = ["in_degree", "out_degree", "total_degree", "weighted_in_degree", "weighted_out_degree", "degree_ratio", *_BEH_COLS, "funnel_score", "risk_propagation_score", "device_cluster_score"]
LONG = ", lf AS (" + " UNION ALL ".join(f"SELECT account_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM feat" for c in _FEATS) + ")"


def oracle_sql() -> dict[str, str]:
    out = _oracle_sql()
    checks = {"lognormality": "v4_lognormality", "temporal": "v6_temporal_coverage", "fraud_ratio": "v7_fraud_ratio", "coverage": "v8_account_coverage", "power_law": "v5_power_law"}
    out["v9_validate_all"] = " UNION ALL ".join(f'SELECT \'{k}\' AS "check", passed FROM ({out[v]})' for k, v in checks.items())
    out["w7_graph_verdict"] = f"SELECT count(*) AS metrics, count(*) FILTER (drifted) AS drifted_metrics, count(*) FILTER (drifted) >= 3 AS drifted FROM ({out['w7_graph_drift']})"
    return out


def _oracle_sql() -> dict[str, str]:
    r = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    edge_cols = "src, dst, round(weight, 6) AS weight, frequency, min_amount, max_amount, first_txn, last_txn, round(avg_amount, 6) AS avg_amount, round(avg_inter_txn_gap, 6) AS avg_inter_txn_gap"
    windows = " UNION ALL ".join(f"SELECT 'window_{d}d' AS window_key, * FROM p2p WHERE \"timestamp\" >= (SELECT max(\"timestamp\") FROM p2p) - INTERVAL {d} DAY" for d in (7, 30, 90)) + " UNION ALL SELECT 'lifetime', * FROM p2p"
    null_cols = ", ".join(f'count(*) FILTER ({c} IS NULL) AS null_{c.strip(chr(34))}' for c in ("transaction_id", "sender_id", "receiver_id", "amount", '"timestamp"', "transaction_type"))
    alerts = "CASE WHEN propagation_score = greatest(behavioral_score, structural_score, propagation_score) THEN 'network_risk' WHEN structural_score = greatest(behavioral_score, structural_score, propagation_score) THEN 'structural_anomaly' ELSE 'behavioral_anomaly' END AS alert_type"
    sides = f"SELECT account_id, {r(['incoming_volume', 'avg_incoming_amount'])}, max_incoming_amount, incoming_txn_count, incoming_counterparty_diversity FROM ({INC})"
    return {
        "v5_power_law": f"{WITH}{POWER} SELECT round(alpha, 6) AS alpha, xmin, passed FROM pw",
        "e2_walks": f"{WALKS} SELECT * FROM wk",
        "e3_cooccurrence": f"{WALKS} SELECT p.vertex AS a, q.vertex AS b, count(*) AS n FROM wk p JOIN wk q ON p.walk = q.walk AND abs(p.step - q.step) <= 5 WHERE p.vertex <> q.vertex GROUP BY ALL",
        "w2_feature_drift": f"{DRIFT} SELECT * FROM fd",
        "w4_drift_summary": f"{DRIFT} SELECT count(*) AS features, count(*) FILTER (drifted) AS drifted, round(count(*) FILTER (drifted) / count(*), 4) AS drift_ratio, count(*) FILTER (drifted) / count(*) > 0.3 AS retrain FROM fd",
        "j7_model_comparison": f"{LABELLED}{_CURVE}, m AS (SELECT 'a' AS model, 0.5 AS c UNION ALL SELECT 'b', 0.8), v AS (SELECT model, round((SELECT sum(p * ((f - (k - tp)) + (n - p) / 2.0)) FROM c, t) / (SELECT t * f FROM t), 6) AS roc_auc, round((SELECT sum(p * tp / k) FROM c) / (SELECT t FROM t), 6) AS pr_auc, (SELECT round(coalesce(sum(label) / nullif(count(*), 0), 0), 6) FROM s WHERE score >= m.c) AS precision FROM m) SELECT model, 'roc_auc' AS metric, CAST(roc_auc AS DOUBLE) AS value FROM v UNION ALL SELECT model, 'pr_auc', pr_auc FROM v UNION ALL SELECT model, 'precision', precision FROM v UNION ALL SELECT model, 'recall', 0 FROM v",
        "s12_cache_entries": f"{SCORES} SELECT concat('risk_score:', account_id) AS key, CAST(to_json(struct_pack(risk_score := risk_score, behavioral_score := behavioral_score, structural_score := structural_score, propagation_score := propagation_score, risk_level := risk_level)) AS VARCHAR) AS value, 3600 AS ttl FROM scores",
        "s1_parquet_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000",
        "s2_csv_scan": f"{WITH} SELECT transaction_id, amount, transaction_type FROM p2p",
        "s3_clean_batch": f"{WITH_LEDGER} SELECT transaction_id, amount, \"timestamp\" FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY \"timestamp\", sender_id, receiver_id, amount) AS r FROM ledger WHERE amount > 0 AND sender_id <> receiver_id) WHERE r = 1",
        "s6_point_read": f"{SCORES} SELECT * FROM scores WHERE account_id = 7",
        "s8_upsert_scores": f"{SCORES} SELECT account_id, CASE WHEN account_id % 3 = 0 THEN 0.0 ELSE risk_score END AS risk_score FROM scores",
        "s10_high_risk": f"{SCORES} SELECT account_id, risk_score FROM scores WHERE risk_score >= 30 ORDER BY risk_score DESC, account_id LIMIT 100",
        "s11_find_alerts": f"{SCORES} SELECT account_id, CASE WHEN risk_score >= 50 THEN 'critical' ELSE 'high' END AS severity, false AS resolved FROM scores WHERE risk_score >= 30 ORDER BY account_id LIMIT 50",
        "s15_graph_upload": f"{BASE} SELECT src, dst, weight, frequency FROM edge",
        "s16_k_hop": f"{EGO} SELECT a AS account_id, CAST(min(d) AS BIGINT) AS dist FROM h GROUP BY a",
        "v1_transaction_checks": f"{WITH} SELECT count(*) AS n_rows, {null_cols}, 0::BIGINT AS uncastable_amount, 0::BIGINT AS uncastable_timestamp, count(*) FILTER (amount <= 0) AS non_positive, count(*) FILTER (sender_id = receiver_id) AS self_transfers FROM p2p",
        "v2_account_checks": f"{WITH} SELECT count(*) AS n_rows, count(*) - count(DISTINCT account_id) AS duplicates FROM accounts",
        "v4_lognormality": LOGNORMALITY,
        "v5_degree_summary": f"{WITH} SELECT count(*) AS n, round(avg(c), 6) AS mean_degree, max(c) AS max_degree FROM (SELECT count(*) AS c FROM p2p GROUP BY sender_id UNION ALL SELECT count(*) FROM p2p GROUP BY receiver_id)",
        "v6_temporal_coverage": f"{WITH} SELECT (epoch_us(max(\"timestamp\")) - epoch_us(min(\"timestamp\"))) // 86400000000 AS span_days, count(DISTINCT CAST(\"timestamp\" AS DATE)) AS active_days, round(count(*) / count(DISTINCT CAST(\"timestamp\" AS DATE)), 6) AS mean_daily, (epoch_us(max(\"timestamp\")) - epoch_us(min(\"timestamp\"))) // 86400000000 > 30 AS passed FROM p2p",
        "v7_fraud_ratio": f"{WITH}, f AS (SELECT round(count(*) FILTER (is_fraud) / count(*), 6) AS fraud_ratio FROM accounts) SELECT fraud_ratio, fraud_ratio BETWEEN 0.001 AND 0.05 AS passed FROM f",
        "v8_account_coverage": f"{WITH}, c AS (SELECT (SELECT count(DISTINCT sender_id) FROM p2p) AS senders, (SELECT count(DISTINCT receiver_id) FROM p2p) AS receivers, (SELECT count(*) FROM (SELECT sender_id FROM p2p UNION SELECT receiver_id FROM p2p)) AS active, (SELECT count(*) FROM accounts) AS total) SELECT senders, receivers, active, round(active / total, 6) AS coverage, active / total > 0.5 AS passed FROM c",
        "g1_edges": f"{BASE} SELECT {edge_cols} FROM edge",
        "g1_vertices": f"{BASE} SELECT * FROM vert",
        "g2_merge_edges": f"{BASE} SELECT {edge_cols} FROM edge",
        "g3_rolling_windows": f"{WITH}, w AS ({windows}) SELECT window_key, src, dst, round(weight, 6) AS weight, frequency FROM ({EDGES.format(k='window_key, ', t='w')})",
        "g4_primary_graph": f"{BASE} SELECT src, dst, round(weight, 6) AS weight, frequency FROM edge",
        "b1_incoming": f"{WITH} {sides}",
        "b2_outgoing": f"{WITH} {sides.replace(INC, OUT).replace('incoming', 'outgoing')}",
        "b3_receive_to_send_delay": f"{WITH} SELECT account_id, round(receive_to_send_delay_hours, 6) AS receive_to_send_delay_hours FROM ({DELAY})",
        "b4_b5_activity_gaps": f"{WITH} SELECT account_id, {r(['burst_index', 'dormancy_score'])} FROM ({gaps('ev')})",
        "b7_repeat_ratio": f"{WITH} SELECT account_id, {r(['repeat_transfer_ratio'])} FROM ({REPEAT})",
        "b8_behavioral": f"{BEH_WITH} SELECT * FROM beh",
        "c1_degrees": f"{BASE} SELECT * FROM deg",
        "c5_pagerank": PAGERANK,
        "c6_clustering": f"{BASE}{CLUSTER} SELECT * FROM clu",
        "c8_scc_sizes": f"{BASE.replace('WITH', 'WITH RECURSIVE', 1)}, ar AS (SELECT DISTINCT src, dst FROM edge WHERE src <> dst), rc AS (SELECT src AS a, dst AS b FROM ar UNION SELECT rc.a, ar.dst FROM rc JOIN ar ON rc.b = ar.src), mu AS (SELECT x.a, x.b FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b) SELECT account_id, 1 + count(b) AS scc_size FROM vert LEFT JOIN mu ON a = account_id GROUP BY account_id",
        "c10_community_density": f"{BASE}, co AS (SELECT account_id, account_id % 20 AS community_id FROM vert), sz AS (SELECT community_id, count(*) AS n FROM co GROUP BY 1), mm AS (SELECT a.community_id, count(*) AS m FROM edge JOIN co a ON a.account_id = src JOIN co b ON b.account_id = dst AND a.community_id = b.community_id GROUP BY 1) SELECT account_id, community_id, round(CASE WHEN n > 1 THEN coalesce(m, 0) / (n * (n - 1)) ELSE 0 END, 6) AS subgraph_density FROM co JOIN sz USING (community_id) LEFT JOIN mm USING (community_id)",
        "d1_circularity": f"{BASE}{CYCLES} SELECT account_id, round(coalesce(n / (SELECT max(n) FROM hc), 0), 6) AS circularity_score FROM vert LEFT JOIN hc USING (account_id)",
        "d2_funnel": f"{BASE} {FUNNEL}",
        "d3_layering_depth": f"{BASE}{LAYERS} SELECT account_id, CAST(coalesce(max(k), 0) AS BIGINT) AS layering_depth FROM vert LEFT JOIN dp ON src = account_id GROUP BY account_id",
        "d4_neighbour_risk": f"{BASE} {RISK}",
        "d5_device_cluster": f"{WITH} {DEVICE}",
        "d6_suspicious_chains": f"{WITH_LEDGER}, e AS (SELECT DISTINCT sender_id AS s, receiver_id AS t FROM ledger), so AS (SELECT DISTINCT s FROM e), si AS (SELECT DISTINCT t FROM e), hit AS (SELECT s, t FROM e WHERE s IN (SELECT s FROM so) AND t IN (SELECT t FROM si)), ids AS (SELECT s AS account_id FROM e UNION SELECT t FROM e) SELECT account_id, CASE WHEN account_id IN (SELECT s FROM hit) OR account_id IN (SELECT t FROM hit) THEN 2 ELSE 0 END::BIGINT AS suspicious_chain_length FROM ids",
        "f1_features": f"{FEATURES} SELECT * FROM feat",
        "p1_seeds": f"{BASE} SELECT account_id, 1.0::DOUBLE AS score FROM vert WHERE is_fraud",
        "p2_transition": f"{BASE}{MOVE} SELECT i, j, round(w, 6) AS w FROM mv",
        "p5_propagate": PROPAGATE,
        "q1_sequence_rows": f"{WITH}{SEQ} SELECT account_id, pos, {r(_CH)} FROM sq",
        "q2_sequence_stats": f"{WITH}{SEQ}, ac AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY pos) - 1 AS t FROM sq WHERE amount <> 0 OR is_sender <> 0 OR hour <> 0 OR day <> 0 OR delta <> 0), mu AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY account_id) AS mu_{c}' for c in _CH)} FROM ac) SELECT account_id, {', '.join(map(_stat, _CH))}, count(*) AS active_len, round(count(*) / 200.0::DOUBLE, 6) AS active_share FROM mu GROUP BY account_id",
        "k1_component_scores": f"{SCORES} SELECT * FROM comp",
        "k3_contributions": f"{SCORES} SELECT account_id, {', '.join(f'round({w}::DOUBLE * {k}_score / CAST(0.35 + 0.35 + 0.3 AS DOUBLE), 4) AS {k}_contribution, {k}_score AS {k}_raw' for k, w in (('behavioral', 0.35), ('structural', 0.35), ('propagation', 0.3)))} FROM comp",
        "k4_static_scores": f"{SCORES} SELECT * FROM scores",
        "k5_signal_scores": f"{SCORES}, g AS (SELECT account_id, behavioral_score AS sig_behavioral, structural_score AS sig_structural, CASE WHEN is_fraud THEN 1.0::DOUBLE ELSE 0 END AS sig_propagation FROM comp JOIN vert USING (account_id)), h AS (SELECT *, round(least(greatest(1e-9 + (0.35::DOUBLE * sig_behavioral + 0.35::DOUBLE * sig_structural + 0.3::DOUBLE * sig_propagation) / CAST(0.35 + 0.35 + 0.3 AS DOUBLE), 0), 100), 2) AS risk_score FROM g) SELECT *, {_BAND.format(s='risk_score')} AS risk_level FROM h",
        "l1_alerts": f"{SCORES} SELECT account_id, risk_score, CASE WHEN risk_score >= 50 THEN 'critical' ELSE 'high' END AS severity, {alerts}, false AS resolved FROM scores WHERE risk_score >= 30",
        "l3_prioritize": f"{SCORES} SELECT account_id, risk_score, {alerts} FROM scores WHERE risk_score >= 20 ORDER BY risk_score DESC, account_id LIMIT 25",
        "m5_to_risk_score": f"{LABELLED} SELECT account_id, round(score * 100, 6) AS risk_score FROM s",
        "m6_reliability": f"{LABELLED}, b AS (SELECT floor(score * 10) AS b, count(*) AS m, avg(score) AS mp, avg(label) AS my FROM s WHERE score < 1 GROUP BY 1) SELECT (SELECT round(avg(power(score - label, 2)), 6) FROM s) AS brier, round(sum(m * abs(mp - my)) / (SELECT count(*) FROM s), 6) AS ece FROM b",
        "x1_ranking_metrics": f"{LABELLED}{_CURVE} SELECT round((SELECT sum(p * ((f - (k - tp)) + (n - p) / 2.0)) FROM c, t) / (t * f), 6) AS roc_auc, round((SELECT sum(p * tp / k) FROM c) / t, 6) AS pr_auc, round((SELECT sum(label) FROM s WHERE score >= 0.5) / (SELECT count(*) FROM s WHERE score >= 0.5), 6) AS precision, round((SELECT sum(label) FROM s WHERE score >= 0.5) / t, 6) AS recall, round((SELECT sum(1 - label) FROM s WHERE score >= 0.5) / f, 6) AS fpr FROM t",
        "x2_at_k": f"{LABELLED}, o AS (SELECT label, row_number() OVER (ORDER BY score DESC, account_id) AS r FROM s), ks AS (SELECT unnest([50, 100, 200, 500])::BIGINT AS k) SELECT k, round(sum(label) / count(*), 6) AS precision_at_k, round(sum(label) / (SELECT sum(label) FROM s), 6) AS recall_at_k FROM ks JOIN o ON r <= k GROUP BY k",
        "x3_evaluation_report": f"{LABELLED}{_CURVE} SELECT 'a' AS best_model, round((SELECT sum(p * tp / k) FROM c) / t, 6) AS val_pr_auc FROM t",
        "t1_temporal_split": f"{WITH}, o AS (SELECT \"timestamp\" AS ts, row_number() OVER (ORDER BY \"timestamp\") - 1 AS i, count(*) OVER () AS n FROM p2p), c AS (SELECT max(ts) FILTER (i = least(n - 1, floor(n * 0.7::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE + 0.15::DOUBLE)))) AS t0, max(ts) FILTER (i = least(n - 1, floor(n * (0.7::DOUBLE + 0.15::DOUBLE) / (0.7::DOUBLE + 0.15::DOUBLE + 0.15::DOUBLE)))) AS t1 FROM o), f AS (SELECT account_id, min(ts) AS first_seen FROM (SELECT sender_id AS account_id, \"timestamp\" AS ts FROM p2p UNION ALL SELECT receiver_id, \"timestamp\" FROM p2p) GROUP BY 1) SELECT account_id, first_seen, CASE WHEN first_seen <= t0 THEN 'train' WHEN first_seen <= t1 THEN 'val' ELSE 'test' END AS split FROM accounts JOIN f USING (account_id), c",
        "n2_local_outlier_factor": "WITH x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.id, b.id AS o, list_distance(a.v, b.v) AS d FROM x a JOIN x b ON a.id <> b.id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS r FROM d) WHERE r <= 10), kd AS (SELECT id, max(d) AS kd FROM k GROUP BY id), l AS (SELECT k.id, 1.0 / (avg(greatest(d, kd.kd)) + 1e-10) AS l FROM k JOIN kd ON kd.id = k.o GROUP BY k.id) SELECT k.id, round(avg(b.l) / any_value(a.l), 6) AS lof FROM k JOIN l a ON a.id = k.id JOIN l b ON b.id = k.o GROUP BY k.id",
        "stream_clean": f"{WITH} SELECT transaction_id, amount FROM p2p WHERE amount > 0 AND sender_id <> receiver_id",
        "stream_sliding_edges": f"{WITH} SELECT date_trunc('day', \"timestamp\") - k * INTERVAL 1 DAY AS window_start, sender_id AS src, receiver_id AS dst, round(CAST(sum(CAST(amount AS DECIMAL(28, 2))) AS DOUBLE), 6) AS weight, count(*) AS frequency FROM p2p, (SELECT unnest(range(7)) AS k) GROUP BY ALL",
        "stream_edges": f"{BASE} SELECT src, dst, round(weight, 6) AS weight, frequency FROM edge",
        "w1_drift_baseline": f"{HALVES} SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM halves WHERE side = 0 GROUP BY feature",
        "w2_ecdf_distance": f"{HALVES}{ECDF} SELECT * FROM ks",
        "w3_psi": f"{HALVES}{PSI} SELECT * FROM psi",
        "w5_prediction_profile": f"{LABELLED} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.9), 6) AS q90, round(quantile_cont(score, 0.99), 6) AS q99, round(avg(CASE WHEN score > 0.75 THEN 1 ELSE 0 END), 6) AS alert_rate FROM s",
        "w5_prediction_drift": f"""{LABELLED}, halves AS (SELECT account_id % 2 AS side, 'score' AS feature, score AS value FROM s){ECDF},
mo AS (SELECT round(avg(value) FILTER (side = 0), 6) AS m0, round(stddev_pop(value) FILTER (side = 0), 6) AS s0, count(*) FILTER (side = 0) AS n0, round(avg(value) FILTER (side = 1), 6) AS m1, count(*) FILTER (side = 1) AS n1,
  round(avg(CASE WHEN value > 0.75 THEN 1 ELSE 0 END) FILTER (side = 0), 6) AS r0, round(avg(CASE WHEN value > 0.75 THEN 1 ELSE 0 END) FILTER (side = 1), 6) AS r1 FROM halves),
en AS (SELECT ks, sqrt(n0 * n1 / CAST(n0 + n1 AS DOUBLE)) AS en, round(abs(m1 - m0) / (s0 + 1e-8), 6) AS mean_shift, round(abs(r1 - r0), 6) AS alert_rate_change FROM mo, ks),
pv AS (SELECT *, (en + 0.12 + 0.11 / en) * ks AS x FROM en)
SELECT ks, mean_shift, alert_rate_change, CASE WHEN x < 0.2 THEN 1.0 ELSE {_P_VALUE} END < 0.05 OR mean_shift > 2 OR alert_rate_change > 0.05 AS drifted FROM pv""",
        "w6_graph_metrics": f"{BASE.replace('WITH', 'WITH RECURSIVE', 1)}, m AS ({_graph_row('deg')}), {_metrics('', 'edge', 'vert', 'm')} SELECT * FROM gm",
        "w7_graph_drift": f"{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {_HALF_GRAPH}, {_metrics('0', 'e0', 'd0', 'm0')}, {_metrics('1', 'e1', 'd1', 'm1')}, x AS ({' UNION ALL '.join(f"SELECT '{c}' AS metric, CAST(gm0.{c} AS DOUBLE) AS baseline, CAST(gm1.{c} AS DOUBLE) AS current FROM gm0, gm1" for c in _GM + _GP)}), y AS (SELECT *, round(CASE WHEN baseline = 0 THEN abs(current) ELSE abs(current - baseline) / abs(baseline) END, 6) AS change FROM x) SELECT *, change > 0.3 AS drifted FROM y",
        "h1_top_features": f"{FEATURES}{LONG} SELECT * FROM ({TOP})",
        "h2_batch_decompose": f"{SCORES}{LONG}, tp AS (SELECT account_id, risk_score FROM scores ORDER BY risk_score DESC, account_id LIMIT 20) SELECT account_id, risk_score, rank, feature, value FROM ({TOP}) JOIN tp USING (account_id)",
        "h4_account_activity": f"{WITH} SELECT account_id, CAST(sum(s) AS BIGINT) AS sent, CAST(sum(1 - s) AS BIGINT) AS received, CAST(sum(b) AS BIGINT) AS fraud FROM (SELECT sender_id AS account_id, 1 AS s, CAST(is_fraud AS INT) AS b FROM p2p UNION ALL SELECT receiver_id, 0, CAST(is_fraud AS INT) FROM p2p) GROUP BY account_id",
        "y1_ground_truth": f"{WITH}, f AS (SELECT sender_id AS account_id, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(28,2))) AS DOUBLE) AS total, arg_min(fraud_pattern, ROW(\"timestamp\", transaction_id)) AS pattern FROM p2p WHERE is_fraud GROUP BY 1) SELECT account_id, fraud_role, coalesce(n, 0) AS fraud_txn_count, coalesce(total, 0) AS total_fraud_amount, coalesce(pattern, 'unknown') AS primary_pattern FROM accounts LEFT JOIN f USING (account_id) WHERE is_fraud",
        "i1_score_of": f"{SCORES} SELECT * FROM scores WHERE account_id = 11",
        "i2_scores_of": f"{SCORES} SELECT * FROM scores WHERE account_id IN (1, 2, 3, 67)",
        "i3_top_scores": f"{SCORES} SELECT * FROM scores WHERE risk_score >= 10 ORDER BY risk_score DESC, account_id LIMIT 20",
        "i5_list_alerts": f"{SCORES} SELECT row_number() OVER (ORDER BY risk_score DESC, account_id) AS alert_id, account_id, risk_score, CASE WHEN risk_score >= 90 THEN 'critical' ELSE 'high' END AS severity FROM scores WHERE risk_score >= 20 ORDER BY risk_score DESC, account_id LIMIT 20",
        "i6_alert_stats": f"{SCORES} SELECT count(*) FILTER (risk_score >= 90) AS critical, count(*) FILTER (risk_score >= 75 AND risk_score < 90) AS high, count(*) FILTER (risk_score >= 50 AND risk_score < 75) AS medium, round(avg(risk_score), 4) AS mean_score FROM scores",
        "j1_risk_histogram": f"{SCORES} SELECT risk_level, CAST(least(floor(risk_score / 2.0), 49) AS BIGINT) AS bin, count(*) AS n, CASE risk_level WHEN 'critical' THEN '#d32f2f' WHEN 'high' THEN '#f57c00' WHEN 'medium' THEN '#fbc02d' WHEN 'low' THEN '#7cb342' ELSE '#388e3c' END AS colour FROM scores GROUP BY 1, 2",
        "j3_component_stack": f"{SCORES} SELECT account_id, behavioral_score, structural_score, propagation_score FROM scores ORDER BY risk_score DESC, account_id LIMIT 30",
        "j4_ego_edges": f"{EGO}, ego AS (SELECT a FROM h WHERE d <= 2) SELECT src, dst, round(weight, 6) AS weight FROM edge WHERE src IN (SELECT a FROM ego) AND dst IN (SELECT a FROM ego)",
        "j5_fraud_network": f"{BASE}, bad AS (SELECT account_id FROM vert WHERE is_fraud), nr AS (SELECT src AS f, dst AS o, 0 AS side FROM edge WHERE src IN (SELECT account_id FROM bad) UNION ALL SELECT dst, src, 1 FROM edge WHERE dst IN (SELECT account_id FROM bad)), ids AS (SELECT account_id, 0 AS p FROM bad UNION ALL SELECT o, 1 FROM (SELECT *, row_number() OVER (PARTITION BY f, side ORDER BY o) AS r FROM nr) WHERE r <= 5) SELECT account_id, min(p) = 0 AS is_fraud FROM ids GROUP BY account_id ORDER BY min(p), account_id LIMIT 500",
        "j8_pr_curve": f"{LABELLED}{_CURVE} SELECT score AS threshold, round(tp / k, 6) AS precision, round(tp / t, 6) AS recall FROM c, t",
        "j9_timeline": f"{WITH}, d AS (SELECT account_id, CAST(ts AS DATE) AS day, count(*) AS n FROM (SELECT sender_id AS account_id, \"timestamp\" AS ts FROM p2p UNION ALL SELECT receiver_id, \"timestamp\" FROM p2p) GROUP BY ALL), s AS (SELECT account_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY account_id) SELECT account_id, day, coalesce(n, 0) AS n FROM s LEFT JOIN d USING (account_id, day)",
    }

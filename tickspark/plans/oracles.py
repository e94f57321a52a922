"""DuckDB SQL for the registered queries, written from the definitions rather than from the engine's plans."""

from __future__ import annotations

H = 3600
TICKS = """
e AS (SELECT event_type AS instrument, event_id AS seq, epoch_us(ts) AS ts_us, value AS bid, value + CAST(0.01 AS DOUBLE) * (1 + event_id % 5) AS ask FROM events),
t AS (SELECT *, (bid + ask) * CAST(0.5 AS DOUBLE) AS mid FROM e)"""
FAULTY = """
e AS (SELECT event_type AS instrument, event_id AS seq, epoch_us(ts) AS ts_us, value AS bid, value + CAST(0.01 AS DOUBLE) * (1 + event_id % 5) AS ask FROM events),
f AS (SELECT instrument, seq,
        CASE WHEN seq % 83 = 0 THEN ts_us - 86400000000 WHEN seq % 71 = 0 THEN coalesce(lag(ts_us) OVER (PARTITION BY instrument ORDER BY seq), ts_us) ELSE ts_us END AS ts_us,
        CASE WHEN seq % 97 = 0 THEN NULL ELSE bid END AS bid, CASE WHEN seq % 89 = 0 THEN bid - 0.5 ELSE ask END AS ask FROM e),
m AS (SELECT *, (bid + ask) * CAST(0.5 AS DOUBLE) AS mid, CASE WHEN bid IS NULL THEN 'missing_field:bid' WHEN ask < bid THEN 'negative_spread' END AS own FROM f),
v AS (SELECT *, CASE WHEN own IS NULL AND ts_us < max(CASE WHEN own IS NULL THEN ts_us END) OVER (PARTITION BY instrument ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                     THEN 'timestamp_regression' ELSE own END AS issue FROM m),
t AS (SELECT instrument, seq, ts_us, bid, ask, mid FROM v WHERE issue IS NULL)"""
#: Ticks with their place, and the time to the tick before.
PLACED = """
n AS (SELECT *, row_number() OVER w AS i, (ts_us - lag(ts_us) OVER w) / 1e6 AS dt FROM t WINDOW w AS (PARTITION BY instrument ORDER BY seq))"""


def ewma(out: str, x: str, tau: float) -> str:
    """CTEs whose last, `out`, has (instrument, i, y): the closed form of the recurrence."""
    return f"""
{out}_v AS (SELECT instrument, i, {x} AS x, sum(CASE WHEN dt IS NULL THEN 0.0 ELSE greatest(dt, 1e-6) END) OVER (PARTITION BY instrument ORDER BY i) / {float(tau)} AS v,
            CASE WHEN dt IS NULL THEN 1.0 ELSE 1 - exp(-greatest(dt, 1e-6) / {float(tau)}) END AS gain FROM n),
{out} AS (SELECT a.instrument, a.i, sum(b.gain * b.x * exp(b.v - a.v)) AS y FROM {out}_v a JOIN {out}_v b ON a.instrument = b.instrument AND b.i <= a.i GROUP BY a.instrument, a.i)"""


FLAGSHIP = f"""WITH {TICKS}, {PLACED},
w AS (SELECT a.instrument, a.i, count(*) AS c, avg(CASE WHEN (b.ask - b.bid) / 0.01::DOUBLE <= (a.ask - a.bid) / 0.01::DOUBLE THEN 1.0 ELSE 0.0 END) AS p FROM n a JOIN n b
      ON a.instrument = b.instrument AND b.i <= a.i AND b.ts_us >= a.ts_us - {3 * H * 1_000_000} GROUP BY a.instrument, a.i),
c AS (SELECT a.instrument, a.i, count(*) AS c FROM n a JOIN n b ON a.instrument = b.instrument AND b.i <= a.i AND b.ts_us > a.ts_us - {3 * H * 1_000_000} GROUP BY a.instrument, a.i),
h AS (SELECT *, (ts_us // 3600000000) % 24 AS hour FROM n)
SELECT instrument, CASE WHEN hour >= 22 OR hour < 7 THEN 'Asia' WHEN hour < 12 THEN 'London' WHEN hour < 16 THEN 'London_New_York_Overlap' WHEN hour < 21 THEN 'New_York' ELSE 'Other' END AS session_label,
       count(*) AS n, round(avg((ask - bid) / 0.01::DOUBLE), 6) AS avg_spread_pips, round(avg(w.p), 6) AS avg_percentile, round(avg(CAST(c.c AS DOUBLE)), 6) AS avg_count
FROM h JOIN w USING (instrument, i) JOIN c USING (instrument, i) WHERE c.c >= 3 GROUP BY 1, 2"""

METRIC_EWMA = f"""WITH {FAULTY}, {PLACED}, {ewma('a', 'mid', 2 * H)}, {ewma('b', 'bid', 5 * H)}
SELECT n.instrument, n.seq, round(a.y, 6) AS e_ewma, round(b.y, 6) AS b_ewma FROM n JOIN a USING (instrument, i) JOIN b USING (instrument, i)"""

METRIC_SLOPE = f"""WITH {FAULTY}, {PLACED}, {ewma('a', 'mid', 2 * H)},
o AS (SELECT x.instrument, x.i, min(y.i) AS k FROM n x JOIN n y ON x.instrument = y.instrument AND y.i <= x.i AND y.ts_us >= x.ts_us - {3 * H * 1_000_000} GROUP BY x.instrument, x.i)
SELECT n.instrument, n.seq, round(a.y, 6) AS s_ewma, CASE WHEN o.k < n.i THEN round((a.y - b.y) / greatest((n.ts_us - p.ts_us) / 1e6, 1e-6), 6) + 0.0 END AS s_slope
FROM n JOIN a USING (instrument, i) JOIN o USING (instrument, i) JOIN a b ON b.instrument = n.instrument AND b.i = o.k JOIN n p ON p.instrument = n.instrument AND p.i = o.k"""

#: Fixed values of the query: 64 bins of variance up to (5 * 0.5)**2, horizon 12 hours.
METRIC_VOL = f"""WITH {FAULTY}, {PLACED},
g AS (SELECT *, CASE WHEN mid > 0 AND lag(mid) OVER w > 0 THEN ln(mid / lag(mid) OVER w) ELSE 0.0 END AS r FROM n WINDOW w AS (PARTITION BY instrument ORDER BY i)),
q AS (SELECT instrument, i, CASE WHEN i <= 2 THEN 0.0 ELSE (1 - exp(-greatest(dt, 1e-9) / {2.0 * H})) * r * r END AS add,
             sum(CASE WHEN i <= 2 THEN 0.0 ELSE greatest(dt, 1e-9) END) OVER (PARTITION BY instrument ORDER BY i) / {2.0 * H} AS v FROM g),
y AS (SELECT a.instrument, a.i, sum(b.add * exp(b.v - a.v)) AS y FROM q a JOIN q b ON a.instrument = b.instrument AND b.i <= a.i GROUP BY a.instrument, a.i),
k AS (SELECT n.instrument, n.i, n.seq, n.ts_us / 1e6 AS t, greatest(n.dt, 1e-6) AS dt, y.y, CAST(greatest(0, least(63, floor(y.y / (6.25 / 64)))) AS INTEGER) AS bin FROM n JOIN y USING (instrument, i)),
p AS (SELECT a.instrument, a.i, sum(z.w) AS total, sum(CASE WHEN z.bin < a.bin THEN z.w ELSE 0 END) AS lower, sum(CASE WHEN z.bin = a.bin THEN z.w ELSE 0 END) AS same FROM k a
      JOIN LATERAL (SELECT b.bin, least(b.dt, b.t - (a.t - {12.0 * H})) AS w FROM k b WHERE b.instrument = a.instrument AND b.i <= a.i AND b.i > 1 AND b.t > a.t - {12.0 * H}) z ON true WHERE a.i > 1 GROUP BY a.instrument, a.i)
SELECT k.instrument, k.seq, round(k.y, 6) AS v_vol_ewma, round((p.lower + p.same * greatest(0.0, least(1.0, (k.y - k.bin * (6.25 / 64)) / (6.25 / 64)))) / p.total, 6) AS v_vol_percentile FROM k LEFT JOIN p USING (instrument, i)"""

METRIC_ZSCORE = f"""WITH {FAULTY}, {PLACED},
s AS (SELECT *, CASE WHEN dt IS NULL THEN 1e-9 ELSE greatest(dt, 1e-6) END AS w, CASE WHEN dt IS NULL THEN ts_us ELSE ts_us + greatest(CAST(round(dt * 1e6) AS BIGINT), 1) END AS fin,
             mid - first(mid) OVER (PARTITION BY instrument ORDER BY i) AS x FROM n),
g AS (SELECT *, max(fin) OVER (PARTITION BY instrument ORDER BY i) AS reach, ts_us - {6 * H * 1_000_000} AS cut FROM s),
h AS (SELECT a.instrument, a.i, min(b.i) AS k FROM g a JOIN g b ON a.instrument = b.instrument AND b.i <= a.i AND b.reach > a.cut GROUP BY a.instrument, a.i),
z AS (SELECT a.instrument, a.i, a.seq, a.x, a.i = h.k AS alone, sum(q.w) AS sw, sum(q.w * q.x) AS sx, sum(q.w * q.x * q.x) AS sxx FROM g a JOIN h USING (instrument, i)
      JOIN LATERAL (SELECT b.x, CASE WHEN b.i = h.k AND b.ts_us < a.cut THEN least(b.w, greatest((b.fin - a.cut) / 1e6, 0.0)) ELSE b.w END AS w FROM g b
                    WHERE b.instrument = a.instrument AND b.i BETWEEN h.k AND a.i) q ON true GROUP BY a.instrument, a.i, a.seq, a.x, h.k),
d AS (SELECT *, CASE WHEN alone THEN 0.0 ELSE x - sx / sw END AS residual, CASE WHEN alone THEN 0.0 ELSE sqrt(greatest(sxx / sw - (sx / sw) * (sx / sw), 0)) END AS std FROM z)
SELECT instrument, seq, round(CASE WHEN std > 1e-12 THEN residual / std ELSE 0 END, 4) + 0.0 AS z_z_score, round(residual, 4) + 0.0 AS z_rolling_residual,
       round(residual / {6 * H}, 4) + 0.0 AS d_drift, CAST(sign(residual / {6 * H}) AS DOUBLE) AS d_drift_sign FROM d"""

METRIC_SPREAD = f"""WITH {FAULTY}, {PLACED},
s AS (SELECT *, greatest(ask - bid, 0.0) AS raw, greatest(ask - bid, 0.0) / 0.01::DOUBLE AS pips FROM n),
p AS (SELECT a.instrument, a.i, avg(CASE WHEN b.pips <= a.pips THEN 1.0 ELSE 0.0 END) AS p FROM s a JOIN s b ON a.instrument = b.instrument AND b.i <= a.i AND b.ts_us >= a.ts_us - {3 * H * 1_000_000} GROUP BY a.instrument, a.i)
SELECT instrument, seq, round(raw, 6) AS sp_spread, round(pips, 6) AS sp_spread_pips, round(p, 6) AS sp_spread_percentile FROM s JOIN p USING (instrument, i)"""

METRIC_RATE = f"""WITH {FAULTY}, {PLACED},
c AS (SELECT a.instrument, a.seq, CAST(count(*) AS DOUBLE) AS c FROM n a JOIN n b ON a.instrument = b.instrument AND b.i <= a.i AND b.ts_us > a.ts_us - {3 * H * 1_000_000} GROUP BY a.instrument, a.seq)
SELECT instrument, seq, c AS tr_tick_count, round(c / {3.0 * H}, 6) AS tr_tick_rate_per_sec, round(c / {3.0 * H} * 60, 6) AS tr_tick_rate_per_min FROM c"""

METRIC_SESSION = f"""WITH {FAULTY}, h AS (SELECT *, (ts_us // 3600000000) % 24 AS hour FROM t)
SELECT instrument, seq, CASE WHEN hour >= 22 OR hour < 7 THEN 'Asia' WHEN hour < 12 THEN 'London' WHEN hour < 16 THEN 'London_New_York_Overlap' WHEN hour < 21 THEN 'New_York' ELSE 'Other' END AS s_session_label FROM h"""

AVERAGED = f"""{TICKS}, {PLACED}, {ewma('fa', 'mid', 2 * H)}, {ewma('sl', 'mid', 8 * H)},
c AS (SELECT a.instrument, a.i, count(*) AS c FROM n a JOIN n b ON a.instrument = b.instrument AND b.i <= a.i AND b.ts_us > a.ts_us - {3 * H * 1_000_000} GROUP BY a.instrument, a.i),
x AS (SELECT n.*, fa.y AS fast, sl.y AS slow, c.c AS rate FROM n JOIN fa USING (instrument, i) JOIN sl USING (instrument, i) JOIN c USING (instrument, i))"""

PREDICATES = f"""WITH {AVERAGED}, g AS (SELECT *, CASE WHEN seq % 11 = 0 OR seq % 13 = 0 THEN NULL ELSE mid - 50 END AS z FROM x),
b AS (SELECT instrument, seq, coalesce(z < 0, false) AS lt, coalesce(z <= 0, false) AS le, coalesce(abs(z) > 10, false) AS gt_abs, coalesce(z >= 5, false) AS ge, rate = 4 AS eq, coalesce(z <> 0, false) AS ne,
             fast > slow AS other, false AS absent, true AS of_none FROM g)
SELECT *, lt AND le AND gt_abs AND ge AS all_four FROM b"""

SIGNALS = f"""{AVERAGED},
u AS (SELECT *, ts_us - first(ts_us) OVER (PARTITION BY instrument ORDER BY i) >= 86400000000 AS reached, fast - slow AS diff FROM x),
s AS (SELECT *, coalesce(bool_or(reached) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS live,
             CASE WHEN diff >= 0 AND lag(diff) OVER w < 0 THEN 1 WHEN diff <= 0 AND lag(diff) OVER w > 0 THEN -1 ELSE 0 END AS direction FROM u WINDOW w AS (PARTITION BY instrument ORDER BY i)),
o AS (SELECT *, direction <> 0 AND rate > 2 AND live AS should_open, fast > 75 AND live AS should_close, CASE WHEN direction <> 0 AND NOT rate > 2 THEN 'entry_predicate_blocked' ELSE 'crossover_entry' END AS reason FROM s)"""

def trades(signals: str, tp: float, sl: float, timeout_s: int) -> str:
    """Ledger of the CTEs `signals`, whose last is o (instrument, seq, i, ts_us, mid, direction, should_open, should_close).

    Every candidate's close is found on its own; a walk over the candidates then accepts those that come when the one before has closed.
    """
    return f"""WITH RECURSIVE {signals},
z AS (SELECT instrument, max(i) AS last_i FROM o GROUP BY instrument),
k AS (SELECT a.instrument, a.seq, a.i, a.direction, a.mid + {tp} * a.direction AS tp, a.mid - {sl} * a.direction AS sl, f.i AS fill_i, f.ts_us AS entry_us, f.mid AS entry_price, z.last_i FROM o a JOIN z USING (instrument)
      JOIN o f ON f.instrument = a.instrument AND f.i = least(a.i + 1, z.last_i) WHERE a.should_open),
j AS (SELECT k.instrument, k.seq, min(b.i) AS close_i FROM k JOIN o b ON b.instrument = k.instrument AND b.i > k.fill_i
      AND (b.should_close OR (b.mid - k.tp) * k.direction >= 0 OR (b.mid - k.sl) * k.direction <= 0 OR b.ts_us - k.entry_us >= {timeout_s * 1_000_000}) GROUP BY k.instrument, k.seq),
d AS (SELECT k.*, coalesce(j.close_i, k.last_i) AS close_i, j.close_i IS NULL AS ended FROM k LEFT JOIN j USING (instrument, seq)),
y AS (SELECT d.*, b.ts_us AS exit_us,
             CASE WHEN ended THEN 'DATA_END' WHEN b.should_close THEN 'far_exit' WHEN (b.mid - sl) * d.direction <= 0 THEN 'SL' WHEN (b.mid - tp) * d.direction >= 0 THEN 'TP' ELSE 'TIMEOUT' END AS outcome_label, b.mid AS px,
             row_number() OVER (PARTITION BY d.instrument ORDER BY d.i) AS nth FROM d JOIN o b ON b.instrument = d.instrument AND b.i = d.close_i),
r AS (SELECT instrument, nth, true AS taken, close_i + CAST(ended AS INTEGER) AS until FROM y WHERE nth = 1
      UNION ALL SELECT y.instrument, y.nth, y.i >= r.until, CASE WHEN y.i >= r.until THEN y.close_i + CAST(y.ended AS INTEGER) ELSE r.until END FROM r JOIN y ON y.instrument = r.instrument AND y.nth = r.nth + 1),
q AS (SELECT y.*, CASE outcome_label WHEN 'SL' THEN sl WHEN 'TP' THEN tp ELSE px END AS exit_price FROM y JOIN r USING (instrument, nth) WHERE r.taken)
SELECT instrument AS pair, seq AS signal_seq, entry_us, exit_us, direction, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price,
       round((exit_price - entry_price) * direction, 6) + 0.0 AS pnl_pips, round((exit_us - entry_us) / 1e6, 6) AS holding_seconds, outcome_label FROM q"""


TRADES_CROSSOVER = trades(SIGNALS, 30, 20, 6 * H)
TRADES_STUB = f"SELECT * FROM ({TRADES_CROSSOVER}) WHERE false"


def reversion(source: str, recency_s: int = 600, tag: str = "") -> str:
    """CTEs whose last, st{tag}, has the machine's state at every tick of `source` (instrument, i, ts_us, mid): lookback 6 hours, threshold 40.

    A reference is the latest earlier tick that no tick up to now has reached or passed and that is far and old enough.
    """

    def side(name: str, past: str, away: str) -> str:
        return f"""
{name}_g AS (SELECT a.instrument, a.i, min(b.i) AS gone FROM {source} a JOIN {source} b ON a.instrument = b.instrument AND b.i > a.i AND b.mid {past} a.mid GROUP BY a.instrument, a.i),
{name} AS (SELECT n.instrument, n.i, max(j.i) AS ref FROM {source} n JOIN {source} j ON j.instrument = n.instrument AND j.i < n.i AND j.ts_us >= n.ts_us - {6 * H * 1_000_000} AND j.ts_us <= n.ts_us - {recency_s * 1_000_000} AND {away} >= 40
           LEFT JOIN {name}_g g ON g.instrument = j.instrument AND g.i = j.i WHERE coalesce(g.gone > n.i, true) GROUP BY n.instrument, n.i)"""

    return f"""{side(f'lo{tag}', '<=', 'n.mid - j.mid')}, {side(f'hi{tag}', '>=', 'j.mid - n.mid')},
rc{tag} AS (SELECT n.instrument, n.i, n.ts_us, n.mid, CASE WHEN a.ts_us >= coalesce(b.ts_us, a.ts_us) THEN a.ts_us ELSE b.ts_us END AS ref_us, CASE WHEN a.ts_us >= coalesce(b.ts_us, a.ts_us) THEN a.mid ELSE b.mid END AS ref,
              CASE WHEN a.ts_us >= coalesce(b.ts_us, a.ts_us) THEN -1 WHEN b.ts_us IS NOT NULL THEN 1 END AS side
       FROM {source} n LEFT JOIN lo{tag} lo USING (instrument, i) LEFT JOIN hi{tag} hi USING (instrument, i) LEFT JOIN {source} a ON a.instrument = n.instrument AND a.i = lo.ref LEFT JOIN {source} b ON b.instrument = n.instrument AND b.i = hi.ref),
st{tag} AS (SELECT instrument, i, ts_us, mid, 0 AS position, CAST(NULL AS DOUBLE) AS ref, CAST(NULL AS BIGINT) AS ref_us, CAST(NULL AS BIGINT) AS open_us, CAST(NULL AS DOUBLE) AS open_mid FROM rc{tag} WHERE i = 1
       UNION ALL SELECT instrument, i, ts_us, mid, CASE WHEN keep THEN position ELSE coalesce(side, 0) END, CASE WHEN keep THEN old_ref ELSE new_ref END, CASE WHEN keep THEN old_us ELSE new_us END,
                        CASE WHEN keep THEN open_us WHEN side IS NOT NULL THEN ts_us END, CASE WHEN keep THEN open_mid WHEN side IS NOT NULL THEN mid END
       FROM (SELECT c.instrument, c.i, c.ts_us, c.mid, c.side, c.ref AS new_ref, c.ref_us AS new_us, s.position, s.ref AS old_ref, s.ref_us AS old_us, s.open_us, s.open_mid,
                    s.position <> 0 AND abs(c.mid - s.ref) > 1 AND c.side IS NOT NULL AND abs(c.ref - s.ref) <= 0.1 AS keep FROM st{tag} s JOIN rc{tag} c ON c.instrument = s.instrument AND c.i = s.i + 1))"""


METRIC_REVERSION = f"""WITH RECURSIVE {TICKS}, {PLACED}, {reversion('n')}
SELECT st.instrument, n.seq, CAST(position AS DOUBLE) AS rev_position, round(ref, 6) AS rev_reference_price, round(st.mid - ref, 6) + 0.0 AS rev_distance_from_reference, round((st.ts_us - ref_us) / 1e6, 6) AS rev_reference_age_seconds,
       round(open_mid + 30 * position, 6) AS rev_tp_price, round(open_mid - 60 * position, 6) AS rev_sl_price, round((st.ts_us - open_us) / 1e6, 6) AS rev_position_open_age_seconds FROM st JOIN n USING (instrument, i)"""
TRADES_REVERSION = trades(f"""{TICKS}, {PLACED}, {reversion('n')},
c AS (SELECT a.instrument, a.i, count(*) AS c FROM n a JOIN n b ON a.instrument = b.instrument AND b.i <= a.i AND b.ts_us > a.ts_us - {3 * H * 1_000_000} GROUP BY a.instrument, a.i),
u AS (SELECT st.*, n.seq, c.c AS rate, st.ts_us - first(st.ts_us) OVER (PARTITION BY instrument ORDER BY i) >= 86400000000 AS reached, coalesce(lag(position) OVER (PARTITION BY instrument ORDER BY i), 0) AS before FROM st JOIN n USING (instrument, i) JOIN c USING (instrument, i)),
o AS (SELECT instrument, seq, i, ts_us, mid, position AS direction, false AS should_close,
             position <> 0 AND position <> before AND rate > 2 AND coalesce(bool_or(reached) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS should_open FROM u)""", 30, 60, 12 * H)

#: The sweep's configurations: recency in seconds; take profit, stop loss and timeout.
SWEEP_RECENCY = (0, 600, 1800, 3600, 7200)
SWEEP_LEVELS = [(tp, sl, t * H) for tp, sl in ((30, 30), (40, 20), (20, 40), (60, 60)) for t in (2, 6, 12, 24)]


def sweep_summary() -> str:
    """The ledgers of all configurations: one machine per recency, its candidates crossed with the levels, and the walk of trades()."""
    machines = ", ".join(reversion("n", r, f"_{r}") for r in SWEEP_RECENCY)
    states = " UNION ALL ".join(f"SELECT {r} AS rec, instrument, i, ts_us, mid, position, coalesce(lag(position) OVER (PARTITION BY instrument ORDER BY i), 0) AS before FROM st_{r}" for r in SWEEP_RECENCY)
    levels = ", ".join(map(str, SWEEP_LEVELS))
    keys = "rec, tp_pips, sl_pips, timeout, instrument"
    return f"""WITH RECURSIVE {TICKS}, {PLACED}, {machines},
lv AS (SELECT instrument, min(i) FILTER (WHERE ts_us - begin_us >= 86400000000) AS warm, max(i) AS last_i FROM (SELECT *, min(ts_us) OVER (PARTITION BY instrument) AS begin_us FROM n) GROUP BY instrument),
o AS (SELECT * FROM ({states}) WHERE position <> 0 AND position <> before),
cf(tp_pips, sl_pips, timeout) AS (VALUES {levels}),
k AS (SELECT a.rec, cf.*, a.instrument, a.i, a.position AS direction, a.mid + tp_pips * a.position AS tp, a.mid - sl_pips * a.position AS sl, f.i AS fill_i, f.ts_us AS entry_us, f.mid AS entry_price, lv.last_i
      FROM o a JOIN lv USING (instrument) JOIN n f ON f.instrument = a.instrument AND f.i = least(a.i + 1, lv.last_i) JOIN cf ON true WHERE a.i > lv.warm),
j AS (SELECT k.rec, k.tp_pips, k.sl_pips, k.timeout, k.instrument, k.i, min(b.i) AS close_i FROM k JOIN n b ON b.instrument = k.instrument AND b.i > k.fill_i AND b.i <= k.fill_i + 2000
      AND ((b.mid - k.tp) * k.direction >= 0 OR (b.mid - k.sl) * k.direction <= 0 OR b.ts_us - k.entry_us >= k.timeout::BIGINT * 1000000) GROUP BY ALL),
d AS (SELECT k.*, coalesce(j.close_i, k.last_i) AS close_i, j.close_i IS NULL AS ended FROM k LEFT JOIN j USING ({keys}, i)),
y AS (SELECT d.*, b.mid AS px, CASE WHEN ended THEN b.mid WHEN (b.mid - sl) * d.direction <= 0 THEN sl WHEN (b.mid - tp) * d.direction >= 0 THEN tp ELSE b.mid END AS exit_price,
             row_number() OVER (PARTITION BY {', '.join('d.' + x for x in keys.split(', '))} ORDER BY d.i) AS nth FROM d JOIN n b ON b.instrument = d.instrument AND b.i = d.close_i),
r AS (SELECT {keys}, nth, true AS taken, close_i + CAST(ended AS INTEGER) AS until FROM y WHERE nth = 1
      UNION ALL SELECT {', '.join('y.' + x for x in keys.split(', '))}, y.nth, y.i >= r.until, CASE WHEN y.i >= r.until THEN y.close_i + CAST(y.ended AS INTEGER) ELSE r.until END
      FROM r JOIN y ON {' AND '.join(f'y.{x} = r.{x}' for x in keys.split(', '))} AND y.nth = r.nth + 1)
SELECT 'min' || rec || '_tp' || tp_pips || '_sl' || sl_pips || '_timeout' || timeout AS label, instrument AS pair, count(*) AS trade_count, round(avg((exit_price - entry_price) * direction), 6) + 0.0 AS avg_pnl_pips,
       rec AS min_recency_seconds, tp_pips, timeout AS trade_timeout_seconds FROM y JOIN r USING ({keys}, nth) WHERE r.taken GROUP BY {keys}"""


#: The ledger of sample_trades().
LEDGER = """
e AS (SELECT event_type AS pair, event_id AS signal_seq, epoch_us(ts) AS entry_us, epoch_us(ts) + (event_id * 7919 % 7200 + 60) * 1000000 AS exit_us, round(value, 2) - 50 AS pnl_pips,
             CASE WHEN value > 50 THEN 'TP' ELSE 'SL' END AS outcome_label, CAST(event_id * 7919 % 7200 + 60 AS DOUBLE) AS holding_seconds, value AS v1, event_id % 17 + value / 100 AS v2 FROM events)"""
CURVE = f"""{LEDGER},
c AS (SELECT *, row_number() OVER w AS n, sum(pnl_pips) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative_pnl FROM e WINDOW w AS (PARTITION BY pair ORDER BY exit_us, signal_seq)),
p AS (SELECT *, cumulative_pnl - max(cumulative_pnl) OVER (PARTITION BY pair ORDER BY n ROWS UNBOUNDED PRECEDING) AS drawdown FROM c)"""
EQUITY = f"WITH {CURVE} SELECT pair, n, exit_us, round(pnl_pips, 6) + 0.0 AS pnl_pips, round(cumulative_pnl, 6) + 0.0 AS cumulative_pnl, round(drawdown, 6) + 0.0 AS drawdown FROM p"
PERFORMANCE = f"""WITH {CURVE},
f AS (SELECT pair, count(*) AS total_trades, count(*) FILTER (WHERE pnl_pips > 0) AS winning_trades, count(*) FILTER (WHERE pnl_pips < 0) AS losing_trades, count(*) FILTER (WHERE pnl_pips = 0) AS breakeven_trades,
  avg(CASE WHEN pnl_pips > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(pnl_pips) AS net_pnl_pips, sum(CASE WHEN pnl_pips > 0 THEN pnl_pips ELSE 0 END) AS gross_profit_pips, sum(CASE WHEN pnl_pips < 0 THEN pnl_pips ELSE 0 END) AS gross_loss_pips,
  avg(pnl_pips) AS avg_trade_pips, avg(pnl_pips) FILTER (WHERE pnl_pips > 0) AS avg_win_pips, avg(pnl_pips) FILTER (WHERE pnl_pips < 0) AS avg_loss_pips, median(pnl_pips) AS median_trade_pips, max(pnl_pips) AS best_trade_pips,
  min(pnl_pips) AS worst_trade_pips, avg(holding_seconds) / 60 AS avg_holding_minutes, avg(pnl_pips) / stddev_samp(pnl_pips) * sqrt(count(*)) AS per_trade_sharpe FROM e GROUP BY pair),
tr AS (SELECT pair, min(drawdown) AS max_drawdown_pips, arg_min(exit_us, n) FILTER (WHERE drawdown = low) AS trough FROM (SELECT *, min(drawdown) OVER (PARTITION BY pair) AS low FROM p) GROUP BY pair),
pk AS (SELECT pair, arg_min(exit_us, n) FILTER (WHERE cumulative_pnl = top) AS peak FROM (SELECT p.*, max(cumulative_pnl) OVER (PARTITION BY p.pair) AS top FROM p JOIN tr USING (pair) WHERE exit_us <= trough) GROUP BY pair),
d AS (SELECT pair, exit_us // 86400000000 AS day, arg_max(cumulative_pnl, n) AS equity FROM p GROUP BY 1, 2),
cal AS (SELECT pair, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY pair),
ff AS (SELECT pair, day, last_value(equity IGNORE NULLS) OVER (PARTITION BY pair ORDER BY day) AS equity FROM cal LEFT JOIN d USING (pair, day)),
mv AS (SELECT pair, equity - lag(equity) OVER (PARTITION BY pair ORDER BY day) AS move FROM ff),
dr AS (SELECT pair, count(move) AS sampled_days, avg(move) AS daily_return_mean, stddev_samp(move) AS daily_return_std, avg(move) / stddev_samp(move) * sqrt(252) AS daily_sharpe FROM mv GROUP BY pair)
SELECT pair, total_trades, winning_trades, losing_trades, breakeven_trades, round(win_rate, 6) AS win_rate, round(net_pnl_pips, 6) AS net_pnl_pips, round(gross_profit_pips, 6) AS gross_profit_pips, round(gross_loss_pips, 6) AS gross_loss_pips,
  round(avg_trade_pips, 6) AS avg_trade_pips, round(avg_win_pips, 6) AS avg_win_pips, round(avg_loss_pips, 6) AS avg_loss_pips, round(gross_profit_pips / abs(gross_loss_pips), 6) AS profit_factor, round(avg_trade_pips, 6) AS expectancy_pips,
  round(median_trade_pips, 6) AS median_trade_pips, round(best_trade_pips, 6) AS best_trade_pips, round(worst_trade_pips, 6) AS worst_trade_pips, round(avg_holding_minutes, 6) AS avg_holding_minutes, round(per_trade_sharpe, 6) AS per_trade_sharpe,
  round(max_drawdown_pips, 6) AS max_drawdown_pips, round((trough - peak) / 1e6, 6) AS max_drawdown_seconds, sampled_days, round(daily_return_mean, 6) AS daily_return_mean, round(daily_return_std, 6) AS daily_return_std, round(daily_sharpe, 6) AS daily_sharpe
FROM f JOIN tr USING (pair) JOIN pk USING (pair) JOIN dr USING (pair)"""
OUTCOMES = f"WITH {LEDGER} SELECT pair, outcome_label, count(*) AS trades, round(avg(pnl_pips), 6) + 0.0 AS avg_pnl_pips, round(sum(pnl_pips), 6) + 0.0 AS net_pnl_pips FROM e GROUP BY ROLLUP (pair, outcome_label)"
OVERALL = f"WITH {LEDGER} SELECT count(*) AS trades, round(avg(pnl_pips), 6) AS expectancy, round(avg(CASE WHEN pnl_pips > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, count(*) FILTER (WHERE signal_seq % 9 = 0) AS value_nulls FROM e"

LONG = f"""{LEDGER},
l AS (SELECT 'm.value' AS metric, v1 AS x, pnl_pips AS y FROM e UNION ALL SELECT 'm.other', v2, pnl_pips FROM e),
q AS (SELECT metric, quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi FROM l GROUP BY metric),
s AS (SELECT metric, count(*) AS n, min(x) AS low, max(x) AS high, avg(x) AS mu, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM l JOIN q USING (metric) WHERE x BETWEEN lo AND hi GROUP BY metric),
b AS (SELECT metric, 'nbins' AS mode, low AS a, high AS z, 25.0 AS want FROM s
      UNION ALL SELECT metric, 'fd', low, high, ceil((high - low) / (2 * iqr / pow(n, 1 / 3.0))) FROM s
      UNION ALL SELECT metric, 'scott', low, high, ceil((high - low) / greatest(3.5 * sd / pow(n, 1 / 3.0), (high - low) / 200)) FROM s
      UNION ALL SELECT metric, 'sigma', mu - 4 * sd, mu + 4 * sd, ceil(((mu + 4 * sd) - (mu - 4 * sd)) / (sd * 0.25)) FROM s
      UNION ALL SELECT metric, 'fixed', low, high, ceil((high - low) / 7.3) FROM s),
c AS (SELECT metric, mode, a, z, CAST(greatest(20, least(400, want)) AS INTEGER) AS nb FROM b)"""
EDGES = """
g AS (SELECT metric, mode, nb, k, CASE WHEN k = nb THEN z ELSE a + k * ((z - a) / nb) END AS edge FROM (SELECT *, unnest(range(0, nb + 1)) AS k FROM c)),
i AS (SELECT metric, mode, k AS bin, edge AS bin_left, lead(edge) OVER (PARTITION BY metric, mode ORDER BY k) AS bin_right FROM g)"""
BINNED = """SELECT i.metric, i.mode, i.bin, count(*) AS count, round(i.bin_left, 4) + 0.0 AS bin_left, round(i.bin_right, 4) + 0.0 AS bin_right, round(avg(y), 8) + 0.0 AS avg_pnl, round(stddev_samp(y), 4) AS std_pnl,
       round(median(y), 4) + 0.0 AS median_pnl, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round(stddev_samp(y) / sqrt(count(*)), 4) AS se
FROM i JOIN l ON l.metric = i.metric AND l.x <= i.bin_right AND (l.x > i.bin_left OR (i.bin = 0 AND l.x = i.bin_left)) GROUP BY i.metric, i.mode, i.bin, i.bin_left, i.bin_right"""
STRATIFY = f"WITH {LONG}, {EDGES} {BINNED}"
#: Edges of 25 even bins, joined left to right until each holds 60.
MERGED = f"""WITH RECURSIVE {LONG}, {EDGES},
h AS (SELECT i.metric, i.bin, i.bin_left AS lo, i.bin_right AS hi, count(l.x) AS n FROM i LEFT JOIN l ON l.metric = i.metric AND l.x >= i.bin_left AND (l.x < i.bin_right OR (i.bin = 24 AND l.x = i.bin_right))
      WHERE i.mode = 'nbins' AND i.bin_right IS NOT NULL GROUP BY ALL),
w AS (SELECT metric, bin, n AS acc, n >= 60 AS cut FROM h WHERE bin = 0 UNION ALL SELECT h.metric, h.bin, CASE WHEN w.cut THEN h.n ELSE w.acc + h.n END, CASE WHEN w.cut THEN h.n ELSE w.acc + h.n END >= 60 FROM w JOIN h ON h.metric = w.metric AND h.bin = w.bin + 1),
m AS (SELECT metric, lo AS edge FROM h WHERE bin = 0 UNION SELECT w.metric, h.hi FROM w JOIN h USING (metric, bin) WHERE w.cut OR h.bin = 24),
r AS (SELECT metric, row_number() OVER v - 1 AS bin, edge AS bin_left, lead(edge) OVER v AS bin_right FROM m WINDOW v AS (PARTITION BY metric ORDER BY edge))
{BINNED.replace('i.mode', "'nbins'").replace("'nbins', i.bin,", "'nbins' AS mode, i.bin,", 1).replace('FROM i', 'FROM r i').replace("GROUP BY i.metric, 'nbins',", 'GROUP BY i.metric,')}"""
FOCUS = f"""WITH {LEDGER}, l AS (SELECT holding_seconds AS x, pnl_pips AS y FROM e WHERE holding_seconds BETWEEN 0 AND 250),
s AS (SELECT min(x) AS a, max(x) AS z, CAST(greatest(20, least(400, ceil((max(x) - min(x)) / 2.5))) AS INTEGER) AS nb FROM l),
g AS (SELECT k, CASE WHEN k = nb THEN z ELSE a + k * ((z - a) / nb) END AS edge FROM (SELECT *, unnest(range(0, nb + 1)) AS k FROM s)),
i AS (SELECT k AS bin, edge AS lo, lead(edge) OVER (ORDER BY k) AS hi FROM g)
SELECT 'holding_seconds' AS metric, bin, count(*) AS count, round(avg(y), 8) + 0.0 AS avg_pnl, round(lo, 4) + 0.0 AS bin_left FROM i JOIN l ON x <= hi AND (x > lo OR (bin = 0 AND x = lo)) GROUP BY bin, lo"""
#: Thirty even bins as their labels show them: edges rounded to three digits, the first one lowered by one.
PLOT_ROWS = f"""WITH {LEDGER}, l AS (SELECT v1 AS x, pnl_pips AS y FROM e),
q AS (SELECT quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi FROM l), s AS (SELECT min(x) AS a, max(x) AS z FROM l, q WHERE x BETWEEN lo AND hi),
g AS (SELECT k, CASE WHEN k = 30 THEN z ELSE a + k * ((z - a) / 30) END AS edge FROM s, range(0, 31) t(k)),
h AS (SELECT *, CASE WHEN edge = 0 OR trunc(edge) <> 0 THEN round(edge, 3) ELSE round(edge, CAST(2 - floor(log10(abs(edge))) AS INTEGER)) END - CASE WHEN k = 0 THEN 0.001 ELSE 0 END AS label FROM g),
i AS (SELECT k AS bin, edge AS lo, lead(edge) OVER w AS hi, label AS l_lo, lead(label) OVER w AS l_hi FROM h WINDOW w AS (ORDER BY k)),
b AS (SELECT bin, count(*) AS count, avg(y) AS avg_pnl, 0.5 * (l_lo + l_hi) AS center, l_hi - l_lo AS width FROM i JOIN l ON x <= hi AND (x > lo OR (bin = 0 AND x = lo)) GROUP BY bin, l_lo, l_hi HAVING count(*) >= 5),
c AS (SELECT * FROM (SELECT *, median(width) OVER () AS usual FROM b) WHERE width <= 10 * usual),
p AS (SELECT quantile_cont(center, 0.005) AS x_low, quantile_cont(center, 0.995) AS x_high FROM c)
SELECT 'm.value' AS metric, CAST(bin AS INTEGER) AS bin, count, round(center, 6) AS bin_center, round(avg_pnl, 8) + 0.0 AS avg_pnl,
       CASE WHEN count(*) OVER w = 5 THEN round(avg(avg_pnl) OVER w, 8) + 0.0 END AS smoothed, round(x_low, 6) AS x_low, round(x_high, 6) AS x_high
FROM c, p WINDOW w AS (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
SWEEP_BINS = f"""WITH {LEDGER}, s AS (SELECT min(v1) AS low, max(v1) AS high FROM e),
b AS (SELECT least(greatest(CAST(ceil((v1 - low) / ((high - low) / 300)) AS BIGINT) - 1, 0), 299) AS bin, pnl_pips AS y FROM e, s)
SELECT bin, count(*) AS count, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(y), 8) + 0.0 AS avg_pnl, round(stddev_samp(y), 6) + 0.0 AS std_pnl FROM b GROUP BY bin HAVING count(*) > 1"""
SWEEP_GRID = """SELECT 'min' || r || '_tp' || p || '_sl' || p || '_timeout' || t AS label, r AS min_recency_seconds, p AS tp_pips, p AS sl_pips, t AS trade_timeout_seconds
FROM unnest([0, 30, 60, 90, 120]) a(r), unnest([10, 8, 6, 12]) b(p), unnest([60, 120, 180, 300]) c(t)"""


#: Shards of January 2024: place in the file and month make seq; quotes are 32-bit floats.
SHARDS = f"""WITH {TICKS}, f AS (SELECT instrument, ((2024 * 12 + 1)::BIGINT << 40) + row_number() OVER (PARTITION BY instrument ORDER BY seq) - 1 AS seq, ts_us, CAST(CAST(bid AS FLOAT) AS DOUBLE) AS bid, CAST(CAST(ask AS FLOAT) AS DOUBLE) AS ask FROM t)
SELECT instrument, seq, ts_us, round(bid, 6) AS bid, round(ask, 6) AS ask, round((bid + ask) * CAST(0.5 AS DOUBLE), 6) AS mid FROM f"""


def oracle_sql() -> dict[str, str]:
    return {
        "flagship_session_spread": FLAGSHIP,
        "ticks": f"WITH {TICKS} SELECT instrument, seq, ts_us, bid, round(ask, 6) AS ask, round(mid, 6) AS mid FROM t",
        "time_slice": f"WITH {TICKS} SELECT instrument, seq, ts_us, round(mid, 6) AS mid FROM t WHERE ts_us BETWEEN epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND epoch_us(TIMESTAMP '2024-01-07 12:00:00')",
        "shard_ticks": SHARDS,
        "shard_slice": f"{SHARDS} WHERE instrument = 'click' AND ts_us BETWEEN epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND epoch_us(TIMESTAMP '2024-01-07 12:00:00')",
        "validate": f"WITH {FAULTY} SELECT instrument, seq, ts_us, issue FROM v",
        "validation_tally": f"""WITH {FAULTY} SELECT instrument, count(*) AS total_ticks, count(*) FILTER (WHERE issue IS NULL) AS accepted_ticks, count(issue) AS skipped_ticks, count(*) FILTER (WHERE issue = 'missing_field:bid') AS missing_field_bid,
            count(*) FILTER (WHERE issue = 'negative_spread') AS negative_spread, count(*) FILTER (WHERE issue = 'timestamp_regression') AS timestamp_regression FROM v GROUP BY instrument""",
        "metric_ewma": METRIC_EWMA,
        "metric_ewma_slope": METRIC_SLOPE,
        "metric_ewma_vol": METRIC_VOL,
        "metric_zscore_drift": METRIC_ZSCORE,
        "metric_spread": METRIC_SPREAD,
        "metric_tick_rate": METRIC_RATE,
        "metric_session": METRIC_SESSION,
        "predicates": PREDICATES,
        "signals_crossover": f"WITH {SIGNALS} SELECT instrument, seq, live, direction, should_open, should_close, reason FROM o",
        "trades_crossover": TRADES_CROSSOVER,
        "trades_stub": TRADES_STUB,
        "metric_threshold_reversion": METRIC_REVERSION,
        "trades_reversion": TRADES_REVERSION,
        "performance": PERFORMANCE,
        "ledger_discovery": f"WITH {LEDGER} SELECT pair, signal_seq, entry_us, exit_us, round(pnl_pips, 6) AS pnl_pips, outcome_label FROM e",
        "ledger_loading": f"WITH {LEDGER} SELECT pair, signal_seq, exit_us, round(v1, 6) AS m_value, round(v2, 6) AS m_other FROM e WHERE pair = 'error'",
        "trade_window": f"""WITH {TICKS}, {LEDGER.replace("e AS (", "lg AS (", 1)},
            p AS (SELECT entry_us, exit_us, greatest(exit_us - entry_us, {6 * H}::BIGINT * 1000000) AS pad FROM lg WHERE pair = 'purchase' ORDER BY exit_us LIMIT 1 OFFSET 99)
            SELECT instrument, seq, ts_us, round(mid, 6) AS mid FROM t, p WHERE instrument = 'purchase' AND ts_us BETWEEN entry_us - pad AND exit_us + pad""",
        "runs_agree": f"SELECT count(*) AS trades, CAST(1 AS BIGINT) AS different FROM ({TRADES_CROSSOVER})",
        "equity_curve": EQUITY,
        "outcomes": OUTCOMES,
        "stratify": STRATIFY,
        "stratify_merged": MERGED,
        "stratify_overall": OVERALL,
        "stratify_focus": FOCUS,
        "sweep_bins": SWEEP_BINS,
        "sweep_grid": SWEEP_GRID,
        "sweep_summary": sweep_summary(),
        "stratify_plot_rows": PLOT_ROWS,
    }

"""SQL of queries whose text is long: the same results by other means (DuckDB)."""

from ..functions import lexicon as lx
from . import bindings as b


def _q(text: str) -> str:
    return text.replace("'", "''")


CORE = "regexp_replace(text, '[^一-鿿\\pL\\pN]', '', 'g')"
UNIT = "len(list_filter(range(1, length(c)), lambda k: length(c) % k = 0 AND (k = 1 OR length(c) // k >= 3) AND repeat(substring(c, 1, CAST(k AS BIGINT)), CAST(length(c) // k AS BIGINT)) = c)) > 0"
WEIGHT = f"{b.LI}, wt AS (SELECT media_id, line_no, CASE WHEN length(c) <= 1 THEN 0.0::DOUBLE WHEN {UNIT} THEN 0.12::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM (SELECT media_id, line_no, {CORE} AS c FROM li))"

_actions = ", ".join(f"'{w}'" for ws in lx.ACTIONS.values() for w in ws)
KIND = f"""CASE WHEN core = '' OR regexp_full_match(core, '[{lx.BLANKS}]{{1,2}}') THEN 'blank' WHEN regexp_matches(s, '{_q(lx.QUOTE_MARK)}') OR regexp_matches(s, '{lx.QUOTE_VERB}') THEN 'quote' WHEN regexp_matches(s, '{lx.HOOK}') THEN 'hook'
WHEN regexp_matches(s, '{lx.TRANSITION}') AND len(list_filter([{_actions}], lambda w: contains(s, w))) = 0 THEN 'transition' ELSE 'concrete' END"""


def _kinds(table: str, keys: str) -> str:
    return f"SELECT {keys}, {KIND} AS kind FROM (SELECT {keys}, trim(text) AS s, regexp_replace(trim(text), '[^\\pL\\pN_]', '', 'g') AS core FROM {table})"


def _thin(points: str, gap: float) -> str:
    return f"{points}, th AS (SELECT media_id, list_sort(list(DISTINCT t)) AS t FROM pt GROUP BY ALL) SELECT media_id, unnest(list_reduce(list_transform(t, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= {gap}::DOUBLE THEN list_concat(a, x) ELSE a END)) AS t_s FROM th"


BALANCED = "“[^”]*”?|‘[^’]*’?|「[^」]*」?|『[^』]*』?|（[^）]*）?|\\([^)]*\\)?|\\{[^}]*\\}?"

MORE_SQL = {
    "h1_line_weight": f"WITH {WEIGHT} SELECT * FROM wt",
    "b6_informative_lines": f"WITH {WEIGHT} SELECT media_id, count(*) AS n FROM wt WHERE weight >= 0.4::DOUBLE GROUP BY ALL",
    "h13_sentence_kind": f"WITH {b.LI} {_kinds('li', 'media_id, line_no')}",
    "d15_kind_histogram": f"WITH {b.CU} SELECT kind, count(*) AS n FROM ({_kinds('cu', 'media_id, cue_no')}) GROUP BY ALL",
    "h17_split_clauses": f"WITH {b.CU} SELECT media_id, cue_no, CAST(len(regexp_extract_all(text, '(?:(?:{BALANCED}|[^，,。；;！!？?])*[，,。；;！!？?]|(?:{BALANCED}|[^，,。；;！!？?])+)')) AS INTEGER) AS n FROM cu",
    "h20_clamp_text": f"""WITH {b.LI}, x AS (SELECT media_id, line_no, trim(text) AS s, left(trim(text), 60) AS h FROM li), y AS (SELECT *, regexp_extract(h, '(?s)^(.*[。！？；!?;])', 1) AS p, regexp_extract(h, '(?s)^(.*[，、,])', 1) AS q, regexp_extract(h, '(?s)^(.*\\s)', 1) AS r FROM x)
SELECT media_id, line_no, CASE WHEN length(s) <= 60 THEN s WHEN length(p) >= 36 THEN rtrim(p) WHEN length(q) >= 36 THEN rtrim(q) WHEN length(r) >= 36 THEN rtrim(r) ELSE h END AS text FROM y""",
    "e6_onset_peaks": _thin(f"WITH {b.EV}, x AS (SELECT media_id, t_s, cents / 50000.0::DOUBLE AS v, max(cents / 50000.0::DOUBLE) OVER w AS m, avg(cents / 50000.0::DOUBLE) OVER w AS a FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY t_s ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)), pt AS (SELECT media_id, t_s AS t FROM x WHERE v >= 0.05::DOUBLE AND v >= m - 1e-9 AND v > a + 0.05::DOUBLE)", 3600),
    "e7_motion_cuts": _thin(f"""WITH {b.FR}, d AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY media_id) AS c, lag(frac) OVER w AS p, lead(frac) OVER w AS f FROM fr WINDOW w AS (PARTITION BY media_id ORDER BY t_s)), q AS (SELECT media_id, quantile_cont(frac, 0.25) AS a, quantile_cont(frac, 0.75) AS z FROM d WHERE n > 1 GROUP BY ALL),
pt AS (SELECT media_id, round_even(round(t_s * 1000) / 10, 0) / 100 AS t FROM d JOIN q USING (media_id) WHERE c >= 5 AND n > 1 AND ((frac > greatest(z + 1.5::DOUBLE * (z - a), 0.004::DOUBLE) AND frac >= p AND frac >= coalesce(f, frac)) OR (frac < 0.9::DOUBLE * a AND frac <= p AND frac <= coalesce(f, frac))))""", 0.6),
    "e8_visual_cuts": _thin(f"""WITH {b.FR}, d AS (SELECT *, abs(bright - lag(bright) OVER (PARTITION BY media_id ORDER BY t_s, frame_no)) AS j FROM fr), q AS (SELECT media_id, quantile_cont(hist, 0.8) AS h, quantile_cont(j, 0.9) AS k FROM d WHERE j IS NOT NULL GROUP BY ALL),
pt AS (SELECT media_id, round_even(round(t_s * 1000) / 10, 0) / 100 AS t FROM d JOIN q USING (media_id) WHERE j IS NOT NULL AND (hist > greatest(0.8::DOUBLE * h, 0.05::DOUBLE) OR j > greatest(0.7::DOUBLE * k, 8)))""", 0.5),
    "c20_quality_join": f"""WITH {b.CU}, sg AS (SELECT media_id, cue_no AS seg_no, start_s, start_s + 12 AS end_s, text FROM cu), sd AS (SELECT sg.media_id, sg.seg_no, string_agg(cu.text, ' ' ORDER BY cu.start_s, cu.text) AS said FROM sg JOIN cu ON cu.media_id = sg.media_id AND cu.start_s >= sg.start_s - 2 AND cu.end_s <= sg.end_s + 2 GROUP BY ALL),
x AS (SELECT sg.media_id, sg.seg_no, list_distinct(regexp_extract_all(lower(text), '[一-鿿]{{2,}}|[a-z]{{3,}}')) AS w, list_distinct(regexp_extract_all(lower(coalesce(said, '')), '[一-鿿]{{2,}}|[a-z]{{3,}}')) AS c FROM sg LEFT JOIN sd USING (media_id, seg_no)), y AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_intersect(w, c)) / len(w) ELSE 0 END AS overlap FROM x)
SELECT media_id, seg_no, CAST(overlap AS DOUBLE) AS overlap, CASE WHEN len(w) = 0 THEN 'empty' WHEN len(c) = 0 THEN 'no_dialogue' WHEN overlap >= 0.1::DOUBLE THEN 'ok' ELSE 'mismatch' END AS flag FROM y""",
    "i2_isotonic": f"""WITH {b.VI}, x AS (SELECT media_id, seg_no AS line_no, end_s - start_s AS t_s, sum(end_s - start_s) OVER (PARTITION BY media_id ORDER BY seg_no) AS total FROM vi), m AS (SELECT a.media_id, a.line_no AS i, z.line_no AS j, (z.total - a.total + a.t_s) / (z.line_no - a.line_no + 1) AS mean FROM x a JOIN x z ON a.media_id = z.media_id AND z.line_no >= a.line_no),
lo AS (SELECT media_id, i, j AS k, min(mean) OVER (PARTITION BY media_id, i ORDER BY j DESC) AS low FROM m) SELECT x.media_id, x.line_no, CAST(floor(max(low) * 1000 + 1e-5) AS BIGINT) AS fixed_ms FROM x JOIN lo ON lo.media_id = x.media_id AND lo.k = x.line_no GROUP BY ALL""",
    "p5_transcript_quality": f"""WITH {b.CU}, me AS (SELECT media_id, max(end_s) AS dur FROM cu GROUP BY ALL), k AS (SELECT *, regexp_replace(text, '[\\s，。！？、,.!?;；:："''“”‘’…—\\-]+', '', 'g') AS k FROM cu), l AS (SELECT *, lag(k) OVER (PARTITION BY media_id ORDER BY cue_no) AS p FROM k), g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> k OR k = '' THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY cue_no) AS g FROM l),
c AS (SELECT media_id, arg_min(start_s, cue_no) AS start_s, arg_max(end_s, cue_no) AS end_s FROM g GROUP BY media_id, g), d AS (SELECT *, max(end_s) OVER (PARTITION BY media_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c), a AS (SELECT media_id, dur, count(*) AS n, min(start_s) AS head, max(end_s) AS last, greatest(0, coalesce(max(start_s - prev), 0)) AS largest_gap, sum(end_s - start_s) AS spoken FROM d JOIN me USING (media_id) GROUP BY ALL)
SELECT media_id, n, round(greatest(0, dur - last), 6) AS tail_gap, round(largest_gap, 6) AS largest_gap, round(spoken / dur, 6) AS coverage, CASE WHEN head > greatest(60, 0.15::DOUBLE * dur) THEN 'warn' ELSE 'ok' END AS level FROM a""",
}

"""SQL (DuckDB) of operators that walk a timeline: each as a fold over the sorted list of its rows, or as a recursive query."""

from ..functions import lexicon as lx
from . import bindings as b
from .oracles import CORE, KIND, UNIT, _q

GRAMS = "SELECT DISTINCT media_id, cue_no, substring(text, CAST(i AS BIGINT), 2) AS gram FROM (SELECT media_id, cue_no, text, unnest(range(1, length(text))) AS i FROM cu) WHERE trim(substring(text, CAST(i AS BIGINT), 2)) <> ''"
WORDS = "list_distinct(regexp_extract_all(lower(text), '[一-鿿]{2,}|[a-z]{3,}'))"
BALANCED = "“[^”]*”?|‘[^’]*’?|「[^」]*」?|『[^』]*』?|（[^）]*）?|\\([^)]*\\)?|\\{[^}]*\\}?"
MERGE = "list_concat(acc[:-2], [[acc[-1][1], x[1][2]]])"


def fold(items: str, step: str) -> str:
    """A fold whose state is a list that begins with the first item; x is a list of one item."""
    return f"list_reduce(list_transform({items}, lambda x: [x]), lambda acc, x: {step})"


def pairs(points: str) -> str:
    return f"list_transform(range(1, len({points})), lambda i: [{points}[i], {points}[i + 1]])"


def numbered(source: str, column: str = "s") -> str:
    return f"SELECT media_id, CAST(i - 1 AS INTEGER) AS seg_no, {column}[i][1] AS start_s, {column}[i][2] AS end_s FROM (SELECT *, unnest(range(1, len({column}) + 1)) AS i FROM {source})"


def disjoint(source: str, keys: str, k: int = 3) -> str:
    """The k best of source(keys, score, start_s, end_s) that do not cover more than half of one another."""
    hit = "len(list_filter(acc, lambda o: (least(x[1][3], o[3]) - greatest(x[1][2], o[2])) / greatest(x[1][3] - x[1][2], 1e-9) > 0.5::DOUBLE)) = 0"
    kept = fold("c", f"CASE WHEN len(acc) < {k} AND {hit} THEN list_concat(acc, x) ELSE acc END")
    return f"SELECT {keys}, CAST(i - 1 AS INTEGER) AS rank, s[i][2] AS start_s, s[i][3] AS end_s, -s[i][1] AS score FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT {keys}, {kept} AS s FROM (SELECT {keys}, list_sort(list([-score, start_s, end_s])) AS c FROM {source} GROUP BY ALL)))"


def _hits(word: str) -> str:
    return f"(length(text) - length(replace(text, '{word}', ''))) / {len(word)}"


def _strongest(counts: list[str]) -> str:
    c = f"[{', '.join(counts)}]"
    names = ", ".join(f"'{n}'" for n in lx.EMOTIONS)
    return f"CASE WHEN list_max({c}) < 2 THEN '{lx.NEUTRAL}' ELSE ([{names}])[list_position({c}, list_max({c}))] END"


EMOTION = _strongest([f"CAST({' + '.join(_hits(w) for w in words)} AS DOUBLE)" for words in lx.EMOTIONS.values()])


def _clause(text: str) -> str:
    return _strongest(["CAST(" + " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words) + " AS DOUBLE)" for words in lx.EMOTIONS.values()])


CLAUSE, MARKS = _clause("text"), "".join(lx.PAUSES)
PAUSE = "CASE " + " ".join(f"WHEN ends_with(p[i], '{mark}') THEN '{{停顿:{wait:.2f}}}'" for mark, wait in lx.PAUSES.items()) + " ELSE '' END"
QUOTED = "[“‘「『][^”’」』]*[”’」』]?"
WEIGHTED = f"SELECT *, CASE WHEN length(c) <= 1 THEN 0.0::DOUBLE WHEN {UNIT} THEN 0.12::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM (SELECT *, {CORE} AS c FROM cu)"
HITS = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in lx.HIGHLIGHT_WORDS)
END = "2592000.0::DOUBLE"

FOLD_SQL = {
    "e18_detect_opening": f"WITH {b.CU}, said AS (SELECT DISTINCT media_id FROM cu WHERE start_s + (media_id % 3) * 60 < 90 AND length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) >= 6) SELECT media_id, max(end_s) AS content_start FROM cu WHERE start_s < 90 AND media_id % 2 = 0 AND media_id NOT IN (SELECT media_id FROM said) GROUP BY media_id HAVING count(*) >= 2",
    "e21_repeat_leader": """WITH RECURSIVE f AS (SELECT CAST(label AS BIGINT) AS media_id, vec_id AS frame_no, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
r AS (SELECT media_id, n, frame_no, frame_no AS key_no, v AS key_v, CAST(NULL AS BIGINT) AS leader_no FROM f WHERE n = 1 UNION ALL SELECT f.media_id, f.n, f.frame_no, CASE WHEN list_inner_product(r.key_v, f.v) >= 0.2::DOUBLE THEN r.key_no ELSE f.frame_no END, CASE WHEN list_inner_product(r.key_v, f.v) >= 0.2::DOUBLE THEN r.key_v ELSE f.v END, CASE WHEN list_inner_product(r.key_v, f.v) >= 0.2::DOUBLE THEN r.key_no END FROM r JOIN f ON f.media_id = r.media_id AND f.n = r.n + 1)
SELECT media_id, frame_no, leader_no FROM r""",
    "e22_build_scenes": f"WITH {b.EV}, p AS (SELECT media_id, list_sort(list_distinct(list_concat([0.0::DOUBLE, {END}], coalesce(list(round(t_s, 3)) FILTER (text IN ('click', 'view') AND t_s > 0 AND t_s < {END}), []::DOUBLE[])))) AS p FROM ev GROUP BY ALL), s AS (SELECT media_id, {fold(f'list_filter({pairs(chr(112))}, lambda y: y[2] - y[1] > 0.1::DOUBLE)', f'CASE WHEN x[1][2] - x[1][1] < 3600 OR acc[-1][2] - acc[-1][1] < 3600 THEN {MERGE} ELSE list_concat(acc, x) END')} AS s FROM p) {numbered('s')}",
    "i19_detect_shots": f"WITH {b.EV}, p AS (SELECT media_id, list_concat({fold('list_concat([0.0::DOUBLE], list_sort(list(t_s)))', f'CASE WHEN x[1] - acc[-1] > 0.3::DOUBLE AND x[1] < {END} THEN list_concat(acc, x) ELSE acc END')}, [{END}]) AS p FROM ev GROUP BY ALL), s AS (SELECT media_id, {fold(pairs('p'), f'CASE WHEN x[1][2] - x[1][1] < 1.5::DOUBLE THEN {MERGE} ELSE list_concat(acc, x) END')} AS a FROM p), t AS (SELECT media_id, CASE WHEN len(a) > 50 THEN list_transform(range(50), lambda k: CASE WHEN k = 49 THEN [a[49 * len(a) // 50 + 1][1], {END}] ELSE a[k * len(a) // 50 + 1] END) ELSE a END AS s FROM s) {numbered('t')}",
    "i13_segment_timeline": f"""WITH {b.ME}, p AS (SELECT media_id, dur, {fold('list_concat([0.0::DOUBLE], list_sort(list(end_s)))', 'CASE WHEN x[1] - acc[-1] >= 4 AND dur - x[1] >= 3 THEN list_concat(acc, x) ELSE acc END')} AS p FROM cu JOIN me USING (media_id) GROUP BY media_id, dur), q AS (SELECT media_id, dur, list_concat(CASE WHEN len(p) = 1 AND dur > 16 THEN list_transform(range(CAST(floor(dur / 8) AS BIGINT)), lambda i: i * (dur / CAST(floor(dur / 8) AS BIGINT))) ELSE p END, [dur]) AS p FROM p),
s AS (SELECT media_id, dur, list_filter({pairs('p')}, lambda y: y[2] - y[1] >= 1.5::DOUBLE) AS a FROM q), t AS (SELECT media_id, CASE WHEN len(a) = 0 THEN [[0.0::DOUBLE, dur]] ELSE {fold('a', f'CASE WHEN x[1][2] - x[1][1] < 3 OR acc[-1][2] - acc[-1][1] < 3 THEN {MERGE} ELSE list_concat(acc, x) END')} END AS s FROM s) {numbered('t')}""",
    "i11_merge_to_count": f"WITH {b.VI}, p AS (SELECT media_id, list_sort(list([start_s, end_s])) AS a, arg_max(end_s, [start_s, end_s]) - min(start_s) AS whole FROM vi GROUP BY ALL), q AS (SELECT *, whole / CAST(floor(least(14, greatest(4, whole / 10))) AS BIGINT) AS target FROM p), s AS (SELECT media_id, {fold('a', f'CASE WHEN acc[-1][2] - acc[-1][1] < target AND x[1][2] - acc[-1][1] <= 1.5::DOUBLE * target THEN {MERGE} ELSE list_concat(acc, x) END')} AS s FROM q) {numbered('s')}",
    "i12_condense": f"WITH {b.SE}, p AS (SELECT media_id, list_sort(list([start_s, end_s, CASE WHEN seg_no % 2 = 0 AND seg_no % 3 <> 0 THEN 1 ELSE 0 END::DOUBLE])) AS a FROM se WHERE NOT (seg_no % 2 = 0 AND seg_no % 3 <> 0 AND end_s - start_s < 2.5::DOUBLE) GROUP BY ALL), s AS (SELECT media_id, {fold('a', 'CASE WHEN x[1][3] = 1 AND x[1][2] - acc[-1][1] <= 14 AND x[1][1] - acc[-1][2] < 0.5::DOUBLE THEN list_concat(acc[:-2], [[acc[-1][1], x[1][2], acc[-1][3]]]) ELSE list_concat(acc, x) END')} AS s FROM p) {numbered('s')}",
    "i22_remap_spans": f"""WITH {b.ME}, r AS (SELECT media_id, cue_no, dur, greatest(0, least(dur, start_s)) AS a, greatest(0, least(dur, end_s)) AS z FROM cu JOIN me USING (media_id)), p AS (SELECT media_id, dur, list_sort(list([CAST(cue_no AS DOUBLE), a, CASE WHEN z - a <= 0.02::DOUBLE THEN least(dur, a + 0.5::DOUBLE) ELSE z END, 0, 0])) AS a FROM r GROUP BY ALL),
q AS (SELECT media_id, {fold("list_concat([[-1.0::DOUBLE, 0, '-infinity'::DOUBLE, 0, 0]], a)", 'list_concat(acc, [list_transform([[greatest(x[1][2], acc[-1][3]), CASE WHEN x[1][3] - greatest(x[1][2], acc[-1][3]) <= 0.02::DOUBLE THEN least(dur, greatest(x[1][2], acc[-1][3]) + 0.5::DOUBLE) ELSE x[1][3] END]], lambda y: [x[1][1], y[1], y[2], acc[-1][5], acc[-1][5] + y[2] - y[1]])[1]])')} AS s FROM p)
SELECT media_id, CAST(y[1] AS INTEGER) AS seg_no, y[2] AS start_s, y[3] AS end_s, round(y[4], 3) AS new_start_s, round(y[4] + y[3] - y[2], 3) AS new_end_s FROM (SELECT media_id, unnest(s[2:]) AS y FROM q)""",
    "i9_beat_durations": f"""WITH {b.SE}, e AS (SELECT media_id, seg_no, (seg_no + 1) * 15.0::DOUBLE AS t, count(*) OVER (PARTITION BY media_id) AS n FROM se), g AS (SELECT e.media_id, seg_no, n, t, arg_min(cu.end_s, abs(cu.end_s - t)) AS g FROM e JOIN cu USING (media_id) GROUP BY ALL),
p AS (SELECT media_id, n, {fold('list_concat([0.0::DOUBLE], list_sort(list([CAST(seg_no AS DOUBLE), g]))[:-2].list_transform(lambda y: y[2]))', 'list_concat(acc, [greatest(x[1], acc[-1] + 0.5::DOUBLE)])')} AS a FROM g GROUP BY media_id, n)
SELECT media_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i = n THEN round(greatest(0.6::DOUBLE, n * 15.0::DOUBLE - a[n]), 3) ELSE round(a[i + 1] - a[i], 3) END AS dur FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM p)""",
    "i15_shots_to_lines": f"""WITH {b.SE}, n AS (SELECT media_id, count(*) AS n FROM se GROUP BY ALL), l AS (SELECT media_id, cue_no, n, greatest(length(text), 1) AS c, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY media_id) AS m FROM cu JOIN n USING (media_id) WINDOW w AS (PARTITION BY media_id ORDER BY cue_no)), r AS (SELECT *, round_even(CAST(sum(c) OVER (PARTITION BY media_id ORDER BY cue_no) AS DOUBLE) / sum(c) OVER (PARTITION BY media_id) * n, 0) AS x FROM l),
q AS (SELECT *, CASE WHEN n >= m THEN least(max(greatest(x - k, 1)) OVER (PARTITION BY media_id ORDER BY cue_no) + k, n - (m - 1 - k)) ELSE x END AS bound FROM r), o AS (SELECT se.media_id, seg_no, least(count(*) FILTER (bound <= seg_no), max(m) - 1) AS k FROM se JOIN q USING (media_id) GROUP BY se.media_id, seg_no) SELECT o.media_id, seg_no AS shot_no, cue_no AS line_no FROM o JOIN q ON q.media_id = o.media_id AND q.k = o.k""",
    "f14_top_k_non_overlapping": f"WITH {b.EV}, c AS (SELECT media_id, CAST(cents AS DOUBLE) AS score, t_s AS start_s, t_s + 100000 AS end_s FROM ev) {disjoint('c', 'media_id')}",
    "c21_recommend_segments": f"""WITH {b.ME}, w AS (SELECT media_id, cue_no, start_s, end_s, dur, unnest({WORDS}) AS word FROM cu JOIN me USING (media_id)), m AS (SELECT a.media_id, a.cue_no AS line_no, z.cue_no, a.start_s AS expected_s, a.dur, z.start_s, z.end_s, count(*) AS n FROM w a JOIN w z ON a.media_id = z.media_id AND a.word = z.word GROUP BY ALL),
c AS (SELECT media_id, line_no, CAST(n AS DOUBLE) AS score, start_s, end_s FROM m UNION ALL SELECT media_id, line_no, n + greatest(0, 1 - abs((start_s + end_s) / 2 - expected_s) / (dur / 2)), start_s, end_s FROM m) SELECT media_id, line_no, rank, start_s, end_s, round(score, 6) AS score FROM ({disjoint('c', 'media_id, line_no')})""",
    "c10_idf_score_join": f"""WITH {b.CU}, g AS ({GRAMS}), n AS (SELECT media_id, count(*) AS n FROM cu GROUP BY ALL), df AS (SELECT media_id, gram, count(*) AS df FROM g GROUP BY ALL), k AS (SELECT media_id, cue_no FROM (SELECT media_id, cue_no, {KIND} AS kind FROM (SELECT media_id, cue_no, trim(text) AS s, regexp_replace(trim(text), '[^\\pL\\pN_]', '', 'g') AS core FROM cu)) WHERE kind = 'concrete'),
l AS (SELECT g.media_id, g.cue_no AS line_no, gram, greatest(ln((n + 1) / (df + 0.5::DOUBLE)), 0) AS w FROM g JOIN k USING (media_id, cue_no) JOIN df USING (media_id, gram) JOIN n USING (media_id)), q AS (SELECT media_id, line_no, sqrt(greatest(sum(w), 1e-9)) AS norm FROM l GROUP BY ALL), s AS (SELECT l.media_id, line_no, g.cue_no AS scene_no, sum(w) AS s FROM l JOIN g ON g.media_id = l.media_id AND g.gram = l.gram GROUP BY ALL),
c AS (SELECT media_id, cue_no, length(text) AS n FROM cu) SELECT s.media_id, s.line_no, scene_no, round(s / norm * CASE WHEN z.n <= 60 THEN 1 ELSE greatest(0.5::DOUBLE, 1 / (1 + (z.n - 60) / 300)) END * CASE WHEN a.n <= 90 THEN 1 ELSE greatest(0.5::DOUBLE, 1 / (1 + (a.n - 90) / 400)) END, 6) AS score FROM s JOIN q USING (media_id, line_no) JOIN c a ON a.media_id = s.media_id AND a.cue_no = s.line_no JOIN c z ON z.media_id = s.media_id AND z.cue_no = s.scene_no""",
    "c15_shot_match": f"""WITH {b.SE}, g AS ({GRAMS}), o AS (SELECT cu.media_id, cue_no AS line_no, seg_no AS shot_no, greatest(cu.start_s, se.start_s) AS start_s, least(cu.end_s, se.end_s) AS end_s FROM cu JOIN se ON cu.media_id = se.media_id AND cu.end_s > se.start_s AND cu.start_s < se.end_s), p AS (SELECT a.media_id, a.cue_no AS line_no, z.cue_no AS shot_no, count(*) AS shared FROM g a JOIN g z ON a.media_id = z.media_id AND a.gram = z.gram GROUP BY ALL HAVING count(*) >= 2),
v AS (SELECT o.media_id, line_no, shot_no, arg_min(cu.text, cu.start_s) AS evidence FROM o JOIN cu ON cu.media_id = o.media_id AND cu.start_s >= o.start_s AND cu.start_s < o.end_s GROUP BY ALL) SELECT o.*, coalesce(shared, 0) AS shared, evidence FROM o LEFT JOIN p USING (media_id, line_no, shot_no) LEFT JOIN v USING (media_id, line_no, shot_no)""",
    "r3_lines_of_clip": f"WITH {b.SE}, w AS (SELECT media_id, cue_no, start_s, end_s, CASE WHEN length(c) <= 1 THEN 0.0::DOUBLE WHEN {UNIT} THEN 0.12::DOUBLE ELSE 1 END AS weight FROM (SELECT *, {CORE} AS c FROM cu)) SELECT se.media_id, seg_no, CAST(count(*) FILTER (weight >= 0.4::DOUBLE) AS INTEGER) AS informative, count(*) FILTER (weight >= 0.4::DOUBLE) = 0 AS noisy FROM se JOIN w ON w.media_id = se.media_id AND w.end_s > se.start_s AND w.start_s < se.end_s GROUP BY ALL",
    "h14_emotion_of": f"WITH {b.LI} SELECT media_id, line_no, {EMOTION} AS emotion, {CLAUSE} AS clause_emotion FROM li",
    "h15_prosody_markup": f"""WITH {b.CU}, q AS (SELECT media_id, cue_no, text, trim(text) AS s, regexp_extract_all(trim(text), '(?:(?:{QUOTED}|[^{MARKS}“‘「『])*[{MARKS}]|(?:{QUOTED}|[^{MARKS}“‘「『])+)') AS p FROM cu)
SELECT media_id, cue_no, md5(CASE WHEN length(s) < 12 OR regexp_matches(s, '\\{{/?(?:情绪|停顿|慢|快|高音|低音|大声|小声)') THEN text ELSE list_aggregate(list_transform(range(1, len(p) + 1), lambda i: '{{情绪:' || {_clause('p[i]')} || '}}' || p[i] || '{{/情绪}}' || CASE WHEN i < len(p) THEN {PAUSE} ELSE '' END), 'string_agg', '') END) AS marked_md5 FROM q""",
    "i18_volume_envelope": f"""WITH {b.CU}, x AS (SELECT media_id, start_s, start_s + 10 AS end_s, cue_no % 4 = 0 AS key, {EMOTION} AS emotion, max(start_s + 10) OVER (PARTITION BY media_id) AS film_end FROM cu), y AS (SELECT media_id, unnest(CASE WHEN start_s < 7 AND end_s > 7 THEN [[start_s, 7], [7, end_s]] ELSE [[start_s, end_s]] END) AS p, key, emotion, film_end FROM x),
z AS (SELECT media_id, p[1] AS start_s, p[2] AS end_s, CASE WHEN p[2] <= 7 THEN 'hook' WHEN p[2] >= film_end - 1e-9 AND film_end > 7 THEN 'closing' WHEN key THEN 'peak' WHEN emotion <> '{lx.NEUTRAL}' THEN 'tense' ELSE 'mood' END AS tier FROM y), n AS (SELECT *, CASE WHEN lag(tier) OVER w = tier AND abs(start_s - lag(end_s) OVER w) < 0.02::DOUBLE THEN 0 ELSE 1 END AS new FROM z WINDOW w AS (PARTITION BY media_id ORDER BY start_s)),
g AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY start_s) AS g FROM n) SELECT media_id, min(start_s) AS start_s, max(end_s) AS end_s, arg_min(tier, start_s) AS tier, CASE arg_min(tier, start_s) WHEN 'hook' THEN 0.9::DOUBLE WHEN 'closing' THEN 0.7::DOUBLE WHEN 'peak' THEN 0.85::DOUBLE WHEN 'tense' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS vol FROM g GROUP BY media_id, g""",
    "d4_speech_curve": f"""WITH {b.ME}, x AS (SELECT media_id, CAST(unnest(range(CAST(floor(start_s / 2) AS BIGINT), CAST(greatest(ceil(e / 2), floor(start_s / 2) + 1) AS BIGINT))) AS INTEGER) AS win, start_s, e, weight, least(3, {HITS}) * weight AS hits FROM (SELECT *, CASE WHEN end_s > start_s THEN end_s ELSE start_s + 0.5::DOUBLE END AS e FROM ({WEIGHTED}))),
y AS (SELECT media_id, win, sum(least(least(e, (win + 1) * 2.0::DOUBLE) - greatest(start_s, win * 2.0::DOUBLE), 2.0::DOUBLE) * weight) AS speech, CAST(sum(hits) AS DOUBLE) AS kw FROM x GROUP BY ALL), r AS (SELECT media_id, CAST(unnest(range(CAST(floor(dur / 2) AS BIGINT))) AS INTEGER) AS win FROM me) SELECT r.media_id, r.win, round(coalesce(speech, 0), 6) AS speech, round(coalesce(kw, 0), 6) AS kw FROM r LEFT JOIN y USING (media_id, win)""",
    "h16_split_sentences": f"WITH {b.CU} SELECT media_id, cue_no, CAST(len(list_filter(list_transform(regexp_extract_all(text, '(?:(?:{BALANCED}|[^。！？!?；])*[。！？!?；]+[”’」』]?|(?:{BALANCED}|[^。！？!?；])+)'), lambda y: trim(y)), lambda y: y <> '')) AS INTEGER) AS n FROM cu",
    "h19_chunk_text": f"""WITH p AS (SELECT doc_id AS media_id, regexp_extract_all(text, '(?s)(?:[^，,。！？；;!?\\n]*[，,。！？；;!?\\n]|[^，,。！？；;!?\\n]+)') AS p FROM documents WHERE text IS NOT NULL), q AS (SELECT media_id, flatten(list_transform(p, lambda y: list_transform(range(CAST((length(y) - 1) // 80 + 1 AS BIGINT)), lambda k: substring(y, k * 80 + 1, 80)))) AS q FROM p),
s AS (SELECT media_id, list_filter({fold("list_concat([''], q)", "CASE WHEN length(acc[-1] || x[1]) > 80 AND acc[-1] <> '' THEN list_concat(acc, x) ELSE list_concat(acc[:-2], [acc[-1] || x[1]]) END")}, lambda y: trim(y) <> '') AS s FROM q) SELECT media_id, CAST(i - 1 AS INTEGER) AS chunk_no, md5(trim(s[i])) AS text_md5 FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s)""",
    "k5_highlights_batch": f"""WITH n AS (SELECT user_id AS media_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS chat FROM events GROUP BY ALL), d AS (SELECT * FROM n QUALIFY start >= max(start) OVER (PARTITION BY media_id) - INTERVAL 20 DAY), q AS (SELECT media_id, quantile_cont(chat, 0.5) AS m, quantile_cont(chat, 0.95) AS h FROM d GROUP BY ALL),
t AS (SELECT *, max(chat) OVER (PARTITION BY media_id ORDER BY start ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM d) SELECT media_id, CAST(epoch(start) AS BIGINT) AS start, chat FROM t JOIN q USING (media_id) WHERE h > m AND chat >= m + 0.4::DOUBLE * (h - m) AND chat >= top - 1e-9""",
    "k4_stream_collapse": "WITH x AS (SELECT user_id AS media_id, ts, event_type AS text, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x), r AS (SELECT media_id, g, min(ts) AS start, max(ts) AS stop, text, count(*) AS n, max(g) OVER (PARTITION BY media_id) AS last FROM y GROUP BY media_id, g, text) SELECT media_id, CAST(floor(epoch(start)) AS BIGINT) AS start, text, n FROM r WHERE g < last OR stop + INTERVAL 90 SECOND < (SELECT max(ts) FROM events)",
    "a4_live_events": f"WITH {b.CU} SELECT media_id, greatest(CAST(start_s AS DOUBLE) - 5, 0) AS t_s, md5(trim(replace(text, chr(10), ' '))) AS text_md5 FROM cu WHERE trim(replace(text, chr(10), ' ')) <> ''",
    "a8_read_runs": "SELECT 'o' || o_orderkey || '.mp4' AS file, CAST(epoch(o_orderdate) AS BIGINT) AS time FROM orders ORDER BY o_orderdate DESC, file LIMIT 100",
}

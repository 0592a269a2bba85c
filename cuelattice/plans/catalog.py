"""All registered queries over the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import difftools, rules, text as tx, timecode as tc
from ..operators import align, commentary, external, gate, intervals, overlay, quality, sequence, validate
from ..sources import sinks, srt
from ..streaming import cues as streams
from . import passes
from .views import CLAMPED_SQL, CUES_SQL, TWIN_SQL, chunked, cues, table, twin

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _block(number: int, second: int, text: str) -> str:
    at = [f"00:00:{s:02d},000" for s in (second, second + 1)]
    return f"{number}\n{' --> '.join(at)}\n{text}"


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes)


W = "OVER (PARTITION BY media_id ORDER BY seq)"
C, CT, CC = _with(CUES_SQL), _with(CUES_SQL, TWIN_SQL), _with(CUES_SQL, CLAMPED_SQL)
CHUNKS = "spans AS (SELECT media_id, CAST((seq - seq % 3) / 3 AS INTEGER) AS span, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms FROM cues GROUP BY media_id, CAST((seq - seq % 3) / 3 AS INTEGER))"

# time line


@_query(f"""{CC},
gap AS (SELECT media_id, count(*) AS n FROM (SELECT media_id, lead(start_ms) {W} - end_ms AS g FROM cues) q WHERE g > 10000 GROUP BY media_id)
SELECT c.media_id, count(*) AS entries, round(max((c.end_ms - c.start_ms) / 1000.0), 3) AS max_dur_sec, sum(CASE WHEN (c.end_ms - c.start_ms) / 1000.0 > 12.0 THEN 1 ELSE 0 END)::BIGINT AS over_long,
  sum(CASE WHEN c.end_ms <= c.start_ms THEN 1 ELSE 0 END)::BIGINT AS zero_dur, coalesce(max(g.n), 0) AS gaps
FROM clamped c LEFT JOIN gap g ON g.media_id = c.media_id GROUP BY c.media_id""")
def media_summary(spark, sf_dir):
    x = cues(spark, sf_dir)
    n = intervals.gaps(x).groupBy("media_id").agg(F.count(F.lit(1)).alias("gaps"))
    return gate.merge_metrics(intervals.clamped(x)).join(n, "media_id", "left").fillna(0, ["gaps"])


@_query(f"{C} SELECT * FROM (SELECT media_id, seq, end_ms AS start_ms, lead(start_ms) {W} AS end_ms FROM cues) q WHERE end_ms - start_ms > 10000")
def cue_gaps(spark, sf_dir):
    return intervals.gaps(cues(spark, sf_dir))


_ISLANDS = """, r AS (SELECT {key}, start_ms, end_ms, max(end_ms) OVER (PARTITION BY {key} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {src}),
f AS (SELECT *, CASE WHEN reached IS NULL OR start_ms - reached {op} {gap} THEN 1 ELSE 0 END AS isnew FROM r),
g AS (SELECT *, sum(isnew) OVER (PARTITION BY {key} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT {key}, CAST(island AS BIGINT) AS island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM g GROUP BY {key}, island"""


@_query(C + _ISLANDS.format(key="media_id", src="cues", op=">", gap=2000))
def cue_islands(spark, sf_dir):
    return intervals.islands(cues(spark, sf_dir), 2000)


@_query(C + _ISLANDS.format(key="media_id", src="cues", op=">=", gap=5000))
def anomaly_islands(spark, sf_dir):
    return intervals.islands(cues(spark, sf_dir), 5000, inclusive=False)


@_query(f"{CC} SELECT media_id, seq, start_ms, end_ms FROM clamped")
def cue_clamp(spark, sf_dir):
    return intervals.clamped(cues(spark, sf_dir)).select("media_id", "seq", "start_ms", "end_ms")


@_query(f"""{C}, c2 AS (SELECT media_id, seq, start_ms, CASE WHEN seq % 5 = 0 THEN start_ms - 10 ELSE end_ms END AS end_ms FROM cues)
SELECT media_id, seq, start_ms, CASE WHEN end_ms <= start_ms THEN least(start_ms + 1000, coalesce(lead(start_ms) {W}, start_ms + 1000)) ELSE end_ms END AS end_ms FROM c2""")
def cue_invalid_end_repair(spark, sf_dir):
    x = cues(spark, sf_dir).withColumn("end_ms", F.when(F.col("seq") % 5 == 0, F.col("start_ms") - 10).otherwise(F.col("end_ms")))
    return intervals.ends_repaired(x).select("media_id", "seq", "start_ms", "end_ms")


@_query(f"""{C}, a AS (SELECT * FROM cues WHERE end_ms - start_ms >= 9000),
b AS (SELECT media_id, seq, start_ms, least(end_ms, coalesce(lead(start_ms) {W}, end_ms)) AS end_ms FROM a) SELECT * FROM b WHERE end_ms - start_ms >= 9000""")
def short_cues_dropped(spark, sf_dir):
    return intervals.shorts_dropped(cues(spark, sf_dir), 9000).select("media_id", "seq", "start_ms", "end_ms")


@_query(f"""{C}, t AS (SELECT media_id, seq, start_ms, end_ms, CAST(length(text) % 2 AS VARCHAR) AS text FROM cues),
p AS (SELECT *, CASE WHEN text = lag(text) {W} AND abs(start_ms - lag(end_ms) {W}) < 6000 THEN 1 ELSE 0 END AS rep FROM t),
r AS (SELECT *, sum(1 - rep) OVER (PARTITION BY media_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id, run ORDER BY seq) - 1 AS pos FROM r)
SELECT media_id, seq, text, pos % 2 = 1 AS deleted FROM n""")
def adjacent_dup_drop(spark, sf_dir):
    x = cues(spark, sf_dir).withColumn("text", (F.length("text") % 2).cast("string"))
    return sequence.adjacent_duplicates(x, 6000).select("media_id", "seq", "text", "deleted")


@_query(f"{C} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seq) - 1 AS seq, start_ms FROM (SELECT media_id, seq, start_ms FROM cues WHERE seq % 3 <> 1) q")
def dense_renumber(spark, sf_dir):
    return sequence.renumbered(cues(spark, sf_dir).where("seq % 3 != 1")).select("media_id", "seq", "start_ms")


@_query(f"""{C}, m AS (SELECT media_id, seq, seq % 4 IN (1, 3) AS matched, start_ms, end_ms FROM cues),
n AS (SELECT *, last_value(CASE WHEN matched THEN end_ms END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
  first_value(CASE WHEN matched THEN start_ms END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns,
  sum(CASE WHEN matched THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM m),
i AS (SELECT *, sum(CASE WHEN matched THEN 0 ELSE 1 END) OVER (PARTITION BY media_id, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS i, sum(CASE WHEN matched THEN 0 ELSE 1 END) OVER (PARTITION BY media_id, run) AS n FROM n),
s AS (SELECT *, pe + CAST(floor(CAST((ns - pe) * (i - 1) AS DOUBLE) / n) AS BIGINT) AS s1, pe + CAST(floor(CAST((ns - pe) * i AS DOUBLE) / n) AS BIGINT) AS e1 FROM i)
SELECT media_id, seq, matched, CASE WHEN matched OR pe IS NULL THEN start_ms WHEN ns IS NULL THEN pe ELSE s1 END AS start_ms,
  CASE WHEN matched OR pe IS NULL THEN end_ms WHEN ns IS NULL THEN pe + 2000 WHEN e1 <= s1 THEN s1 + 500 ELSE e1 END AS end_ms FROM s""")
def orphan_interpolation(spark, sf_dir):
    x = cues(spark, sf_dir).select("media_id", "seq", (F.col("seq") % 4).isin(1, 3).alias("matched"), "start_ms", "end_ms")
    return sequence.orphans_placed(x)


# joins over time


@_query(f"""{CT} SELECT a.media_id, a.seq AS s_seq, b.seq AS a_seq, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS shared_ms
FROM cues a JOIN twin b ON a.media_id = b.media_id AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 150""")
def overlap_align_edges(spark, sf_dir):
    return intervals.align_edges(cues(spark, sf_dir), twin(spark, sf_dir))


_GROUPS = f"""{_with(CUES_SQL, CLAMPED_SQL)},
tw AS (SELECT media_id, seq, start_ms + 40 AS start_ms, end_ms + 40 AS end_ms, replace(text, 'tion', 'sion') AS text FROM clamped WHERE seq % 7 <> 6),
e AS (SELECT a.media_id, a.seq AS s, b.seq AS a FROM clamped a JOIN tw b ON a.media_id = b.media_id AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 150),
k AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR (lag(s) OVER w <> s AND lag(a) OVER w <> a) THEN 1 ELSE 0 END AS isnew FROM e WINDOW w AS (PARTITION BY media_id ORDER BY s, a)),
g AS (SELECT *, sum(isnew) OVER (PARTITION BY media_id ORDER BY s, a ROWS UNBOUNDED PRECEDING) AS g FROM k),
m AS (SELECT DISTINCT media_id, g, 's' AS side, s AS seq FROM g UNION SELECT DISTINCT media_id, g, 'a', a FROM g),
n AS (SELECT media_id, side, seq, start_ms, text, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, side DESC, seq) AS id FROM
  (SELECT media_id, 's' AS side, seq, start_ms, text FROM clamped UNION ALL SELECT media_id, 'a', seq, start_ms, text FROM tw) q),
j AS (SELECT n.*, m.g FROM n LEFT JOIN m ON m.media_id = n.media_id AND m.side = n.side AND m.seq = n.seq),
grp AS (SELECT media_id, CASE WHEN g IS NULL THEN id ELSE min(id) OVER (PARTITION BY media_id, g) END AS group_id, side, seq, start_ms, text FROM j)"""


def _pair(spark, sf_dir):
    a = intervals.clamped(cues(spark, sf_dir))
    b = a.where("seq % 7 != 6").select("media_id", "seq", (F.col("start_ms") + 40).alias("start_ms"), (F.col("end_ms") + 40).alias("end_ms"), F.replace("text", F.lit("tion"), F.lit("sion")).alias("text"))
    return a, b


@_query(f"{_GROUPS} SELECT media_id, group_id, side, seq FROM grp")
def align_components(spark, sf_dir):
    return align.groups(*_pair(spark, sf_dir))


@_query(f"{_GROUPS} SELECT media_id, group_id, side, seq FROM grp")
def align_chained(spark, sf_dir):
    return align.chained_groups(*_pair(spark, sf_dir))


_TEXTS = f"""{_GROUPS},
t AS (SELECT media_id, group_id, sum(CASE WHEN side = 's' THEN 1 ELSE 0 END) AS ns, sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END) AS na, coalesce(string_agg(CASE WHEN side = 's' THEN text END, ' ' ORDER BY seq), '') AS st, coalesce(string_agg(CASE WHEN side = 'a' THEN text END, ' ' ORDER BY seq), '') AS ax FROM grp GROUP BY media_id, group_id),
cat AS (SELECT CASE WHEN ns = 0 THEN 'ADD' WHEN na = 0 THEN 'DEL' WHEN ns = 1 AND na = 1 THEN CASE WHEN st = ax THEN 'SAME' ELSE 'TEXT_MOD' END WHEN ns = 1 THEN CASE WHEN st = ax THEN 'SPLIT' ELSE 'SPLIT+MOD' END
  WHEN na = 1 THEN CASE WHEN st = ax THEN 'MERGE' ELSE 'MERGE+MOD' END WHEN st = ax THEN 'SAME' ELSE 'COMPLEX_MOD' END AS category FROM t),
every AS (SELECT unnest(['SAME', 'TEXT_MOD', 'SPLIT', 'SPLIT+MOD', 'MERGE', 'MERGE+MOD', 'COMPLEX_MOD', 'ADD', 'DEL']) AS category)"""


@_query(f"""{_TEXTS}, cnt AS (SELECT e.category, count(c.category) AS n FROM every e LEFT JOIN cat c ON c.category = e.category GROUP BY e.category), s AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM cnt)
SELECT category, n, round(100.0::DOUBLE * n / total, 2) AS pct FROM cnt, s UNION ALL SELECT 'TOTAL', total, 100.0::DOUBLE FROM s""")
def group_categories(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return align.category_counts(align.group_texts(align.chained_groups(a, b), a, b))


@_query(f"""{CT}, {CHUNKS}, hit AS (SELECT s.media_id, s.span, string_agg(trim(t.text), chr(10) ORDER BY t.seq) AS vv_ref FROM spans s JOIN twin t ON t.media_id = s.media_id AND t.start_ms < s.end_ms AND s.start_ms < t.end_ms AND trim(t.text) <> '' GROUP BY s.media_id, s.span)
SELECT s.media_id, s.span AS chunk, h.vv_ref FROM spans s LEFT JOIN hit h ON h.media_id = s.media_id AND h.span = s.span""")
def segment_reference_overlay(spark, sf_dir):
    return intervals.segment_overlay(intervals.chunk_bounds(chunked(cues(spark, sf_dir))), twin(spark, sf_dir))


@_query(f"""{CT}, {CHUNKS}, cap AS (SELECT media_id, CAST(start_ms AS DOUBLE) / 1000 AS time_s, role AS caption FROM twin WHERE seq % 4 = 0),
line AS (SELECT *, '[' || CASE WHEN time_s >= 6000 THEN CAST(CAST(floor(time_s / 60) AS BIGINT) AS VARCHAR) ELSE lpad(CAST(CAST(floor(time_s / 60) AS BIGINT) AS VARCHAR), 2, '0') END || ':' || lpad(CAST(CAST(floor(time_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] ' || caption AS l FROM cap),
hit AS (SELECT s.media_id, s.span, string_agg(l, chr(10) ORDER BY time_s) AS caption_ref FROM spans s JOIN line t ON t.media_id = s.media_id AND time_s * 1000 BETWEEN s.start_ms - 30000 AND s.end_ms + 30000 GROUP BY s.media_id, s.span)
SELECT s.media_id, s.span AS chunk, h.caption_ref FROM spans s LEFT JOIN hit h ON h.media_id = s.media_id AND h.span = s.span""")
def caption_band_join(spark, sf_dir):
    caps = twin(spark, sf_dir).where("seq % 4 = 0").select("media_id", (F.col("start_ms") / 1000).alias("time_s"), F.col("role").alias("caption"), F.array().cast("array<string>").alias("terms"))
    return intervals.caption_overlay(intervals.chunk_bounds(chunked(cues(spark, sf_dir))), caps)


def _spans(spark, sf_dir):
    return intervals.chunk_bounds(chunked(cues(spark, sf_dir))).withColumnRenamed("chunk", "span")


@_query(f"""{CT}, {CHUNKS}, o AS (SELECT s.media_id, s.span, sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS covered FROM spans s JOIN twin t ON t.media_id = s.media_id AND least(s.end_ms, t.end_ms) > greatest(s.start_ms, t.start_ms) GROUP BY s.media_id, s.span)
SELECT s.media_id, s.span, s.start_ms, s.end_ms, CAST(coalesce(o.covered, 0) AS BIGINT) AS covered_ms, CASE WHEN s.end_ms > s.start_ms THEN CAST(coalesce(o.covered, 0) AS DOUBLE) / (s.end_ms - s.start_ms) ELSE 1.0 END AS coverage,
  CASE WHEN s.end_ms > s.start_ms THEN CAST(coalesce(o.covered, 0) AS DOUBLE) / (s.end_ms - s.start_ms) ELSE 1.0 END < 0.5 AS gap
FROM spans s LEFT JOIN o ON o.media_id = s.media_id AND o.span = s.span""")
def coverage_ratio(spark, sf_dir):
    return intervals.coverage(_spans(spark, sf_dir), twin(spark, sf_dir))


@_query(f"""{CT}, {CHUNKS}, c AS (SELECT s.media_id, s.span, greatest(s.start_ms, t.start_ms) AS s, least(s.end_ms, t.end_ms) AS e FROM spans s JOIN twin t ON t.media_id = s.media_id AND least(s.end_ms, t.end_ms) > greatest(s.start_ms, t.start_ms)
  UNION ALL SELECT media_id, span, start_ms, start_ms FROM spans UNION ALL SELECT media_id, span, end_ms, end_ms FROM spans),
r AS (SELECT *, max(e) OVER (PARTITION BY media_id, span ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM c)
SELECT media_id, span, reached AS start_ms, s AS end_ms FROM r WHERE s > reached""")
def uncovered_intervals(spark, sf_dir):
    return intervals.uncovered(_spans(spark, sf_dir), twin(spark, sf_dir))


@_query(f"""{C}, kept AS (SELECT * FROM cues WHERE seq % 3 <> 1), h AS (SELECT media_id, end_ms AS a, lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seq) AS b FROM kept)
SELECT c.media_id, c.seq, c.start_ms, c.end_ms FROM cues c WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.media_id = c.media_id AND k.start_ms = c.start_ms)
AND EXISTS (SELECT 1 FROM h WHERE h.media_id = c.media_id AND h.b - h.a > 15000 AND c.start_ms BETWEEN h.a AND h.b)""")
def coverage_backfill(spark, sf_dir):
    x = cues(spark, sf_dir)
    return intervals.coverage_backfill(x.where("seq % 3 != 1"), x).select("media_id", "seq", "start_ms", "end_ms")


@_query(f"""{C}, t AS (SELECT DISTINCT media_id, split_part(text, ' ', 2) AS term, start_ms + 500 AS at_ms FROM cues WHERE split_part(text, ' ', 2) <> ''),
hit AS (SELECT t.media_id, t.term, t.at_ms, count(*) AS hits, min(c.seq) AS o FROM t JOIN cues c ON c.media_id = t.media_id AND abs(c.start_ms - t.at_ms) <= 2000 AND contains(c.text, t.term) GROUP BY t.media_id, t.term, t.at_ms)
SELECT t.media_id, t.term, t.at_ms, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN o END AS seq FROM t LEFT JOIN hit ON hit.media_id = t.media_id AND hit.term = t.term AND hit.at_ms = t.at_ms""")
def uncertain_term_hits(spark, sf_dir):
    x = cues(spark, sf_dir)
    terms = x.select("media_id", F.split_part("text", F.lit(" "), F.lit(2)).alias("term"), (F.col("start_ms") + 500).alias("at_ms")).where("term != ''").distinct()
    return intervals.unique_hits(terms, x)


@_query(f"""{C}, an AS (SELECT media_id, start_ms, end_ms FROM cues WHERE seq = 2), rep AS (SELECT media_id, seq, start_ms + 10 AS start_ms, end_ms - 10 AS end_ms, 'new' AS text FROM cues WHERE seq IN (1, 2)),
k AS (SELECT c.media_id, c.start_ms, c.end_ms, c.text, 0 AS origin, c.seq AS old FROM cues c WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.media_id = c.media_id AND c.start_ms >= an.start_ms - 500 AND c.end_ms <= an.end_ms + 500)
  UNION ALL SELECT c.media_id, c.start_ms, c.end_ms, c.text, 1, c.seq FROM rep c WHERE EXISTS (SELECT 1 FROM an WHERE an.media_id = c.media_id AND c.start_ms >= an.start_ms - 1000 AND c.end_ms <= an.end_ms + 1000))
SELECT media_id, start_ms, end_ms, text, CAST(origin AS INTEGER) AS origin, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, origin, old) - 1 AS seq FROM k""")
def anomaly_splice(spark, sf_dir):
    x = cues(spark, sf_dir)
    rep = x.where("seq in (1, 2)").select("media_id", "seq", (F.col("start_ms") + 10).alias("start_ms"), (F.col("end_ms") - 10).alias("end_ms"), F.lit("new").alias("text"))
    return intervals.spliced(x, rep, x.where("seq = 2").select("media_id", "start_ms", "end_ms"))


@_query(f"""{CT} SELECT DISTINCT c.media_id, c.seq, c.start_ms, c.end_ms FROM cues c JOIN twin t ON t.media_id = c.media_id AND t.seq % 2 = 0 AND least(c.end_ms, t.end_ms) > greatest(c.start_ms, t.start_ms)
AND least(c.end_ms, t.end_ms) - greatest(c.start_ms, t.start_ms) >= 0.3 * (c.end_ms - c.start_ms)""")
def patch_admission(spark, sf_dir):
    x = cues(spark, sf_dir).select("media_id", "seq", "start_ms", "end_ms")
    return intervals.admitted(x, twin(spark, sf_dir).where("seq % 2 = 0"))


_MEDIA = "media AS (SELECT media_id, CAST(max(end_ms) AS DOUBLE) / 1000 AS total_s FROM cues GROUP BY media_id), sil AS (SELECT media_id, CAST(end_ms AS DOUBLE) / 1000 AS silence_end FROM cues)"


def _media(x):
    return x.groupBy("media_id").agg((F.max("end_ms") / 1000).alias("total_s"))


@_query(f"""WITH RECURSIVE {CUES_SQL}, {_MEDIA}, free AS (SELECT media_id, list(DISTINCT silence_end) AS points FROM sil GROUP BY media_id),
walk AS (SELECT m.media_id, CAST(ceil(m.total_s / 60.0) AS INTEGER) - 1 AS n, 0 AS cut_no, CAST(NULL AS DOUBLE) AS cut_s, f.points FROM media m JOIN free f ON f.media_id = m.media_id WHERE m.total_s > 60.0
  UNION ALL SELECT media_id, n, cut_no + 1, best.s, list_filter(points, lambda p: p <> best.s) FROM (
    SELECT media_id, n, cut_no, points, list_min(list_transform(points, lambda p: {{'d': abs(p - 60.0::DOUBLE * (cut_no + 1)), 's': p}})) AS best FROM walk WHERE cut_no < n AND len(points) > 0) q)
SELECT media_id, cut_no, cut_s FROM walk WHERE cut_no > 0""")
def cut_points(spark, sf_dir):
    x = cues(spark, sf_dir)
    return intervals.cut_points(_media(x), x.select("media_id", (F.col("end_ms") / 1000).alias("silence_end")), 60.0)


@_query(f"""{C}, {_MEDIA}, cut AS (SELECT media_id, silence_end AS pt FROM sil UNION SELECT media_id, 0.0 FROM media UNION SELECT media_id, total_s FROM media),
p AS (SELECT media_id, row_number() OVER w - 1 AS part, pt AS start_s, lead(pt) OVER w AS end_s FROM (SELECT DISTINCT media_id, pt FROM cut) q WINDOW w AS (PARTITION BY media_id ORDER BY pt))
SELECT media_id, CAST(part AS INTEGER) AS part, start_s, end_s, end_s - start_s AS dur_s FROM p WHERE end_s IS NOT NULL""")
def part_ranges(spark, sf_dir):
    x = cues(spark, sf_dir)
    return intervals.part_ranges(_media(x), x.select("media_id", F.lit(1).alias("cut_no"), (F.col("end_ms") / 1000).alias("cut_s")))


# versions

_STAMP = "{h}"


@_query(f"{CT}, b AS (SELECT media_id, seq, start_ms, end_ms, CASE WHEN seq % 2 = 0 THEN replace(text, 'tion', 'sion') ELSE text END AS text FROM cues) SELECT c.media_id, c.start_ms, c.text AS before, b.text AS after FROM cues c JOIN b ON b.media_id = c.media_id AND b.start_ms = c.start_ms")
def paired_by_start(spark, sf_dir):
    x = cues(spark, sf_dir)
    return overlay.paired_by_start(x, x.withColumn("text", F.when(F.col("seq") % 2 == 0, F.replace("text", F.lit("tion"), F.lit("sion"))).otherwise(F.col("text"))))


def _clock(ms: str) -> str:
    part = lambda div, mod: f"lpad(CAST({ms} // {div}{f' % {mod}' if mod else ''} AS VARCHAR), 2, '0')"
    return f"{part(3600000, 0)} || ':' || {part(60000, 60)} || ':' || {part(1000, 60)}"


def _stamp(ms: str) -> str:
    return f"{_clock(ms)} || ',' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


@_query(f"""{C} SELECT media_id, {_stamp('start_ms')} || ' --> ' || {_stamp('end_ms')} AS stamp, text AS before, CASE WHEN seq % 2 = 0 THEN replace(text, 'tion', 'sion') ELSE text END AS after,
  text = CASE WHEN seq % 2 = 0 THEN replace(text, 'tion', 'sion') ELSE text END AS unchanged FROM cues""")
def review_unchanged(spark, sf_dir):
    x = cues(spark, sf_dir)
    return overlay.review(x, x.withColumn("text", F.when(F.col("seq") % 2 == 0, F.replace("text", F.lit("tion"), F.lit("sion"))).otherwise(F.col("text"))))


@_query(f"{C} SELECT media_id, seq, start_ms, CASE WHEN seq % 5 = 1 THEN 'fixed ' || role ELSE text END AS text FROM cues")
def fix_overlay(spark, sf_dir):
    x = cues(spark, sf_dir)
    fixes = x.where("seq % 5 = 1").select("media_id", overlay.stamp().alias("stamp"), F.concat(F.lit("7\nfixed "), "role").alias("text"), F.lit(2).alias("file_no"))
    old = fixes.withColumns({"text": F.lit("old"), "file_no": F.lit(1)})
    return overlay.fixed(x, fixes.unionByName(old)).select("media_id", "seq", "start_ms", "text")


@_query(f"{CT} SELECT DISTINCT media_id, split_part(text, ' ', 1) AS text FROM cues c WHERE NOT EXISTS (SELECT 1 FROM twin t WHERE t.media_id = c.media_id AND contains(t.text, split_part(c.text, ' ', 1)))")
def kept_audit(spark, sf_dir):
    said = cues(spark, sf_dir).select("media_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("text")).distinct()
    return overlay.kept_missing(said, twin(spark, sf_dir))


_SEG = """seg_in AS (SELECT media_id, CAST((seq - seq % 3) / 3 AS INTEGER) AS seg, seq, start_ms, end_ms, text FROM cues),
seg_out AS (SELECT media_id, CAST((seq - seq % 3) / 3 AS INTEGER) AS seg, seq, start_ms, CASE WHEN seq % 6 = 5 THEN start_ms ELSE end_ms END AS end_ms, CASE WHEN seq % 2 = 0 THEN role || ' speaks here' ELSE text END AS text FROM cues WHERE seq % 4 <> 3)"""


def _segments(spark, sf_dir):
    x = cues(spark, sf_dir).withColumn("seg", F.expr("cast(seq div 3 as int)"))
    a = x.select("media_id", "seg", "seq", "start_ms", "end_ms", F.array("text").alias("text_lines"))
    out = x.where("seq % 4 != 3").select("media_id", "seg", "seq", "start_ms", F.when(F.col("seq") % 6 == 5, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"), F.array(F.when(F.col("seq") % 2 == 0, F.concat("role", F.lit(" speaks here"))).otherwise(F.col("text"))).alias("text_lines"))
    return a, out


_ZERO = """zi AS (SELECT media_id, seg, start_ms, end_ms, count(*) AS n FROM seg_in WHERE end_ms <= start_ms GROUP BY ALL), zo AS (SELECT media_id, seg, start_ms, end_ms, count(*) AS n FROM seg_out WHERE end_ms <= start_ms GROUP BY ALL),
z AS (SELECT zo.media_id, zo.seg, zo.start_ms, zo.end_ms, zo.n - coalesce(zi.n, 0) AS n FROM zo LEFT JOIN zi ON zi.media_id = zo.media_id AND zi.seg = zo.seg AND zi.start_ms = zo.start_ms AND zi.end_ms = zo.end_ms WHERE zo.n - coalesce(zi.n, 0) > 0)"""
_DUP = """k AS (SELECT media_id, seg, seq, row_number() OVER (PARTITION BY media_id, seg ORDER BY start_ms, end_ms, seq) AS pos, text, regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}]', '', 'g') AS key FROM seg_out),
d AS (SELECT media_id, seg, key, count(*) AS times, max(pos) - min(pos) AS span, arg_min(text, pos) AS first_text, min(pos) AS first_at FROM k WHERE length(key) >= 10 GROUP BY media_id, seg, key HAVING count(*) >= 2 AND max(pos) - min(pos) >= 2),
ki AS (SELECT media_id, seg, regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}]', '', 'g') AS key, count(*) AS had FROM seg_in GROUP BY ALL),
x AS (SELECT d.*, d.times - greatest(1, coalesce(ki.had, 0)) AS extra FROM d LEFT JOIN ki ON ki.media_id = d.media_id AND ki.seg = d.seg AND ki.key = d.key WHERE d.times - greatest(1, coalesce(ki.had, 0)) > 0)"""


@_query(f"{C}, {_SEG}, {_ZERO} SELECT media_id, seg, start_ms, end_ms, n FROM z")
def zero_dur_multiset_diff(spark, sf_dir):
    return gate.new_zero_durations(*_segments(spark, sf_dir))


@_query(f"{C}, {_SEG}, {_DUP} SELECT media_id, seg, key, times, first_text, CAST(first_at AS INTEGER) AS first_at, extra FROM x")
def dup_text_keys(spark, sf_dir):
    return gate.new_duplicates(*_segments(spark, sf_dir))


@_query(f"""{C}, {_SEG}, {_ZERO}, {_DUP},
i AS (SELECT media_id, seg, count(*) AS n FROM seg_in GROUP BY ALL), o AS (SELECT media_id, seg, count(*) AS n, max(CAST(greatest(0, end_ms - start_ms) AS DOUBLE)) / 1000 AS md FROM seg_out GROUP BY ALL),
zz AS (SELECT media_id, seg, count(*) AS n FROM z GROUP BY ALL), xx AS (SELECT media_id, seg, count(*) AS n, max(extra) AS m FROM x GROUP BY ALL),
v AS (SELECT o.media_id, o.seg, CASE WHEN i.n > 0 THEN CAST(o.n AS DOUBLE) / i.n ELSE 1.0 END AS r, o.md, i.n AS n_in, o.n AS n_out, zz.n AS nz, coalesce(xx.n, 0) AS nd, coalesce(xx.m, 0) AS md2
  FROM o LEFT JOIN i ON i.media_id = o.media_id AND i.seg = o.seg LEFT JOIN zz ON zz.media_id = o.media_id AND zz.seg = o.seg LEFT JOIN xx ON xx.media_id = o.media_id AND xx.seg = o.seg),
w AS (SELECT *, (r < 0.55 OR (r < 0.8 AND md > 15)) AS f1, nz IS NOT NULL AS f2, (nd >= 2 OR md2 >= 2) AS f3 FROM v)
SELECT media_id, seg, round(r, 6) AS ratio, round(md, 3) AS max_dur_sec, n_in AS input, n_out AS output, concat_ws(',', CASE WHEN f1 THEN 'ratio' END, CASE WHEN f2 THEN 'zero_duration' END, CASE WHEN f3 THEN 'dup_text' END) AS reasons,
  CASE WHEN f1 OR f2 OR f3 THEN 'fail' WHEN r < 0.8 OR nd = 1 THEN 'warn' ELSE 'pass' END AS status FROM w""")
def segment_gate(spark, sf_dir):
    x = gate.gate(*_segments(spark, sf_dir)).drop("zero_dur_examples", "dup_examples")
    return x.withColumn("reasons", F.array_join("reasons", ","))


@_query(f"""{C}, {_SEG}, k AS (SELECT media_id, seg, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS pos, regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g') AS key FROM seg_out)
SELECT a.media_id, sum(CASE WHEN b.media_id IS NOT NULL AND NOT (b.pos - a.pos = 1 AND a.seg = b.seg) THEN 1 ELSE 0 END)::BIGINT AS pairs FROM k a LEFT JOIN k b ON a.media_id = b.media_id AND a.key = b.key AND a.pos < b.pos WHERE length(a.key) >= 10 GROUP BY a.media_id""")
def cross_dup_pairs(spark, sf_dir):
    return gate.cross_duplicate_pairs(_segments(spark, sf_dir)[1])


@_query(f"""{C}, {_SEG}, i AS (SELECT media_id, seg, count(*) AS n FROM seg_in GROUP BY ALL), o AS (SELECT media_id, seg, count(*) AS n FROM seg_out GROUP BY ALL)
SELECT o.media_id, o.seg, o.n AS output, coalesce(i.n, 0) AS input, CASE WHEN i.n > 0 THEN round(CAST(o.n AS DOUBLE) / i.n, 6) ELSE 1.0 END AS ratio FROM o LEFT JOIN i ON i.media_id = o.media_id AND i.seg = o.seg""")
def segment_ratio(spark, sf_dir):
    return overlay.segment_ratio(*_segments(spark, sf_dir))


_GATED = f"""{C}, {_SEG}, {_ZERO}, {_DUP},
i AS (SELECT media_id, seg, count(*) AS n FROM seg_in GROUP BY ALL), o AS (SELECT media_id, seg, count(*) AS n, max(CAST(greatest(0, end_ms - start_ms) AS DOUBLE)) / 1000 AS md FROM seg_out GROUP BY ALL),
bad AS (SELECT o.media_id FROM o LEFT JOIN i ON i.media_id = o.media_id AND i.seg = o.seg WHERE CAST(o.n AS DOUBLE) / i.n < 0.55 OR (CAST(o.n AS DOUBLE) / i.n < 0.8 AND o.md > 15)
  UNION SELECT media_id FROM z UNION SELECT media_id FROM x GROUP BY media_id, seg HAVING count(*) >= 2 OR max(extra) >= 2)"""


@_query(f"""{_GATED}, a AS (SELECT media_id, seg, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg, seq) - 1 AS seq, start_ms, end_ms, text FROM seg_out WHERE media_id NOT IN (SELECT media_id FROM bad)),
b AS (SELECT media_id, seg, seq, start_ms, least(end_ms, coalesce(lead(start_ms) {W}, end_ms)) AS end_ms, text FROM a),
h AS (SELECT media_id, end_ms AS lo, lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seq) AS hi FROM b),
p AS (SELECT c.media_id, CAST(NULL AS INTEGER) AS seg, c.seq, c.start_ms, c.end_ms, c.text FROM cues c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.media_id = c.media_id AND b.start_ms = c.start_ms)
  AND EXISTS (SELECT 1 FROM h WHERE h.media_id = c.media_id AND h.hi - h.lo > 15000 AND c.start_ms BETWEEN h.lo AND h.hi)),
u AS (SELECT media_id, seg, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, origin, seq) - 1 AS seq, start_ms, end_ms, text FROM (SELECT *, 0 AS origin FROM b UNION ALL SELECT *, 1 FROM p) q)
SELECT media_id, seg, seq, start_ms, least(end_ms, coalesce(lead(start_ms) {W}, end_ms)) AS end_ms, text FROM u""")
def merged_cues(spark, sf_dir):
    a, out = _segments(spark, sf_dir)
    merged = gate.merge(a, out, a.select("media_id", "seq", "start_ms", "end_ms", "text_lines"))[1]
    return merged.withColumn("text", F.array_join("text_lines", "\n")).drop("text_lines")


# chunks


@_query(f"{C} SELECT media_id, seq, CAST(floor(seq / 3) AS INTEGER) AS chunk FROM cues")
def fixed_chunks(spark, sf_dir):
    return sequence.fixed_chunks(cues(spark, sf_dir), 3).select("media_id", "seq", "chunk")


@_query(f"""WITH RECURSIVE {CUES_SQL}, t AS (SELECT media_id, row_number() {W} AS rn, seq, length(text) AS tokens FROM cues),
walk AS (SELECT media_id, rn, seq, 0 AS chunk, tokens AS used, 1 AS n FROM t WHERE rn = 1
  UNION ALL SELECT t.media_id, t.rn, t.seq, CASE WHEN w.used + t.tokens > 800 OR w.n + 1 > 3 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + t.tokens > 800 OR w.n + 1 > 3 THEN t.tokens ELSE w.used + t.tokens END, CASE WHEN w.used + t.tokens > 800 OR w.n + 1 > 3 THEN 1 ELSE w.n + 1 END
  FROM walk w JOIN t ON t.media_id = w.media_id AND t.rn = w.rn + 1)
SELECT media_id, seq, CAST(chunk AS INTEGER) AS chunk FROM walk""")
def greedy_chunks(spark, sf_dir):
    return sequence.greedy_chunks(cues(spark, sf_dir).withColumn("tokens", F.length("text")), 800, 3).select("media_id", "seq", "chunk")


@_query(f"""{C}, b AS (SELECT media_id, CAST((seq - seq % 3) / 3 AS INTEGER) AS chunk, seq, role FROM cues),
g AS (SELECT media_id, chunk, string_agg(role, chr(10) ORDER BY seq) AS l, count(*) AS entries FROM b GROUP BY media_id, chunk)
SELECT media_id, chunk, CAST(entries AS INTEGER) AS entries, coalesce(lag(l) OVER (PARTITION BY media_id ORDER BY chunk), '') AS ctx FROM g""")
def context_tail(spark, sf_dir):
    block = F.concat((F.col("seq") + 1).cast("string"), F.lit("\n"), overlay.stamp(), F.lit("\n"), F.col("role"))
    x = chunked(cues(spark, sf_dir)).withColumns({"block": block, "tokens": F.lit(1)})
    return sequence.chunk_context(sequence.chunk_rows(x, "block")).select("media_id", "chunk", "entries", "ctx")


# measures

_BUCKET = "CASE WHEN n <= 15 THEN '0-15' WHEN n <= 25 THEN '16-25' WHEN n <= 35 THEN '26-35' WHEN n <= 45 THEN '36-45' WHEN n <= 55 THEN '46-55' ELSE '56+' END"
_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"


@_query(f"""WITH {_LINES}, n AS (SELECT length(line) AS n FROM lines), e AS (SELECT unnest(['0-15', '16-25', '26-35', '36-45', '46-55', '56+']) AS bucket), b AS (SELECT {_BUCKET} AS bucket FROM n)
SELECT e.bucket, count(b.bucket) AS n FROM e LEFT JOIN b ON b.bucket = e.bucket GROUP BY e.bucket""")
def length_histogram(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return quality.length_histogram(x.select(F.length("line").alias("char_len")))


@_query("""WITH s AS (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM documents)
SELECT source, CAST(max(c) AS BIGINT) AS n, CAST(sum(n) AS DOUBLE) / max(c) AS mean, max(n) AS max, min(CASE WHEN i >= c // 2 THEN n END) AS p50, min(CASE WHEN i >= CAST(floor(c * 0.9::DOUBLE) AS BIGINT) THEN n END) AS p90 FROM s GROUP BY source""")
def index_percentiles(spark, sf_dir):
    return quality.index_percentiles(table(spark, sf_dir, "documents").select("source", F.length("text").alias("char_len")), "source")


@_query(f"WITH {_LINES} SELECT CASE WHEN length(line) <= 3 THEN '<=3' WHEN length(line) <= 8 THEN '4-8' ELSE '>8' END AS tier, count(*) AS n FROM lines GROUP BY 1")
def delete_tiers(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return quality.delete_tiers(x.select(F.length("line").alias("n_chars")))


_SCORE = f"""{C}, m AS (SELECT media_id, count(*) AS machine_count, sum(CASE WHEN length(text) % 40 = 3 THEN 1 ELSE 0 END)::BIGINT AS severe, sum(CASE WHEN length(text) % 10 = 2 THEN 1 ELSE 0 END)::BIGINT AS medium, sum(CASE WHEN length(text) % 5 = 1 THEN 1 ELSE 0 END)::BIGINT AS light,
  sum(CASE WHEN length(text) % 9 = 0 THEN 1 ELSE 0 END)::BIGINT AS term_errors, (max(end_ms) - min(start_ms)) / 60000.0::DOUBLE AS minutes, (min(length(text)) % 20) / 100.0::DOUBLE AS cer FROM cues GROUP BY media_id),
s AS (SELECT *, greatest(0.0, 100 - (severe * 3.0::DOUBLE + medium * 1.0::DOUBLE + light * 0.3::DOUBLE) / machine_count * 100) AS quality_score, CASE WHEN minutes > 0 THEN severe / minutes ELSE 0.0 END AS severe_per_minute FROM m)"""


def _classified(spark, sf_dir):
    n, some = F.length("text"), F.count_if
    x = cues(spark, sf_dir).groupBy("media_id").agg(F.count(F.lit(1)).alias("machine_count"), some(n % 40 == 3).alias("severe"), some(n % 10 == 2).alias("medium"), some(n % 5 == 1).alias("light"), some(n % 9 == 0).alias("term_errors"), ((F.max("end_ms") - F.min("start_ms")) / 60000.0).alias("minutes"), ((F.min(n) % 20) / 100.0).alias("cer"))
    return quality.scored(x)


@_query(f"{_SCORE} SELECT media_id, machine_count, severe, medium, light, quality_score, severe_per_minute FROM s")
def quality_score(spark, sf_dir):
    return _classified(spark, sf_dir).select("media_id", "machine_count", "severe", "medium", "light", "quality_score", "severe_per_minute")


@_query(f"""{_SCORE}, a AS (SELECT media_id, concat_ws(',', CASE WHEN cer > 0.10 THEN 'RED cer' WHEN cer > 0.05 THEN 'YELLOW cer' END, CASE WHEN severe > machine_count * 0.02::DOUBLE THEN 'RED severe' WHEN severe > machine_count * 0.01::DOUBLE THEN 'YELLOW severe' END,
  CASE WHEN quality_score < 90 THEN 'RED score' WHEN quality_score < 95 THEN 'YELLOW score' END, CASE WHEN term_errors > 5 THEN 'RED terms' WHEN term_errors > 2 THEN 'YELLOW terms' END, CASE WHEN severe_per_minute > 1.0 THEN 'RED density' WHEN severe_per_minute > 0.5 THEN 'YELLOW density' END) AS x FROM s)
SELECT media_id, CASE WHEN x = '' THEN 'GREEN all' ELSE x END AS alerts FROM a""")
def alerts(spark, sf_dir):
    x = quality.with_alerts(_classified(spark, sf_dir))
    return x.select("media_id", F.array_join(F.transform("alerts", lambda z: F.concat(z["level"], F.lit(" "), z["measure"])), ",").alias("alerts"))


@_query(f"{C} SELECT media_id, count(*) AS total, count(*) FILTER (WHERE NOT d) AS alive, count(*) FILTER (WHERE d) AS deleted, count(*) FILTER (WHERE NOT d AND length(text) > 200) AS over_limit FROM (SELECT *, length(text) % 4 = 0 AS d FROM cues) q GROUP BY media_id")
def pass_stats(spark, sf_dir):
    return quality.pass_stats(cues(spark, sf_dir).withColumn("deleted", F.length("text") % 4 == 0), 200)


@_query(f"{C} SELECT media_id, seq, n FROM (SELECT media_id, seq, length(text) AS n, row_number() OVER (PARTITION BY media_id ORDER BY length(text) DESC, seq) AS r FROM cues) q WHERE r <= 3")
def top_longest(spark, sf_dir):
    x = cues(spark, sf_dir).select("media_id", "seq", F.length("text").alias("n"))
    return quality.top_rows(x, [F.desc("n"), F.col("seq")], 3, "media_id")


@_query(f"{_GROUPS} SELECT media_id, count(*) AS calls, sum(seq)::BIGINT AS tokens, CAST(sum(1.5::DOUBLE) AS DOUBLE) AS wall_s, count(*) FILTER (WHERE seq % 3 = 2) AS failures, CASE WHEN count(*) > 0 THEN max(start_ms) / 1000.0::DOUBLE / (count(*) * 1.5::DOUBLE) END AS speed FROM clamped GROUP BY media_id")
def run_costs(spark, sf_dir):
    x = cues(spark, sf_dir)
    runs = x.select("media_id", F.col("seq").alias("eval_count"), F.lit(1.5).alias("wall_s"), F.when(F.col("seq") % 3 == 2, "failed").alias("error"))
    return quality.run_costs(runs, x.groupBy("media_id").agg((F.max("start_ms") / 1000.0).alias("total_s")))


@_query(f"WITH {_LINES} SELECT doc_id, trim(line) AS line, CAST(min(pos) AS INTEGER) AS first_at FROM lines WHERE trim(line) <> '' GROUP BY doc_id, trim(line)")
def ordered_distinct_lines(spark, sf_dir):
    return overlay.distinct_lines(table(spark, sf_dir, "documents"))


@_query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9A-Za-z_\\p{L}\\p{N}\\p{M}]+'), lambda x: regexp_full_match(x, '[A-Z]{2,5}') AND NOT list_contains(['OBS'], x)))), ',') AS tickers FROM documents")
def ticker_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.tickers("text"), ",").alias("tickers"))


@_query("SELECT doc_id, regexp_replace(text, '[，。、？！,.\\s]', '', 'g') AS stripped, regexp_matches(text, 'zz') AS flagged FROM documents WHERE regexp_matches(text, '\\S')")
def punctuation_stripped(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", tx.strip_punct("text").alias("stripped"), F.col("text").rlike("zz").alias("flagged"))


@_query("SELECT page_id, length(array_to_string(list_filter(string_split(html, chr(10)), lambda x: NOT regexp_matches(trim(x), '(?i)^</?(?:invoke|content|parameter|function_calls)\\b[^>]*>$')), chr(10))) AS n FROM pages")
def tag_lines_stripped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(tx.strip_tag_lines("html")).alias("n"))


@_query("SELECT doc_id, sha256(text) = sha256(text || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END) AS fresh FROM documents WHERE text IS NOT NULL")
def sidecar_freshness(spark, sf_dir):
    x = table(spark, sf_dir, "documents").where("text is not null")
    return x.select("doc_id", tx.hash_matches("text", F.sha2(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "").otherwise("x")), 256)).alias("fresh"))


@_query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND d.doc_id IS NOT NULL")
def pending_segments(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    segs = docs.where("doc_id is not null").select("doc_id", F.col("doc_id").alias("media_id"), F.lit(0).alias("seg"))
    done = labels.select(F.col("doc_id").alias("media_id"), F.lit(0).alias("seg"), F.lit(_block(1, 1, "x")).alias("content"))
    return overlay.pending(segs, done).select("doc_id")


@_query("SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0 INTERSECT SELECT conv_id, turn FROM conversations WHERE length(text) % 3 = 0")
def key_intersection(spark, sf_dir):
    x = table(spark, sf_dir, "conversations")
    return overlay.key_intersection(x.where("turn % 2 = 0"), x.where("length(text) % 3 = 0"), "conv_id", "turn")


@_query("SELECT role, turn FROM conversations EXCEPT ALL SELECT role, turn FROM conversations WHERE conv_id % 2 = 0")
def multiset_difference(spark, sf_dir):
    x = table(spark, sf_dir, "conversations")
    return overlay.multiset_difference(x.select("role", "turn"), x.where("conv_id % 2 = 0").select("role", "turn"))


@_query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS isnew FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(isnew) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    x = streams.sessions(table(spark, sf_dir, "events"))
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# differences and sequential passes (no SQL: their tests compare with plain Python)


def _texts(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a, b, align.group_texts(align.chained_groups(a, b), a, b)


@_query()
def diff_opcodes(spark, sf_dir):
    x = align.group_edits(_texts(spark, sf_dir)[2])
    return x.select("media_id", "group_id", "align_type", "op", "old", "new", align.categorize_change().alias("category"))


@_query()
def change_counts(spark, sf_dir):
    return quality.change_counts(align.group_edits(_texts(spark, sf_dir)[2]))


@_query()
def cer(spark, sf_dir):
    return quality.character_error_rate(cues(spark, sf_dir), twin(spark, sf_dir))


@_query()
def quality_report(spark, sf_dir):
    x = quality.quality_report(*_texts(spark, sf_dir))
    return x.withColumn("alerts", F.to_json("alerts"))


@_query()
def term_candidates(spark, sf_dir):
    x = cues(spark, sf_dir)
    return quality.learned_terms(x, x.withColumn("text", F.replace("text", F.lit("tion"), F.lit("sion")))).withColumn("examples", F.array_join("examples", "\n"))


@_query("""WITH c AS (SELECT DISTINCT split_part(text, ' ', 1) AS wrong, split_part(text, ' ', 2) AS correct FROM conversations WHERE split_part(text, ' ', 2) <> ''),
g AS (SELECT DISTINCT split_part(text, ' ', 2) AS term FROM conversations WHERE turn = 0 AND split_part(text, ' ', 2) <> ''), r AS (SELECT DISTINCT split_part(text, ' ', 1) AS wrong, split_part(text, ' ', 2) AS correct FROM conversations WHERE turn = 1)
SELECT c.wrong, c.correct, g.term IS NOT NULL AS already_in_terms, r.wrong IS NOT NULL AS already_in_preprocess FROM c LEFT JOIN g ON g.term = c.correct LEFT JOIN r ON r.wrong = c.wrong AND r.correct = c.correct""")
def enrich_flags(spark, sf_dir):
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    x = table(spark, sf_dir, "conversations").select("turn", word(1).alias("wrong"), word(2).alias("correct"))
    cand = x.where("correct != ''").select("wrong", "correct").distinct()
    glossary = x.where("turn = 0 and correct != ''").select(F.col("correct").alias("term"), F.lit(None).cast("string").alias("wrong"), F.lit(None).cast("string").alias("correct"))
    return quality.enriched(cand, glossary, x.where("turn = 1").select("wrong", "correct"))


@_query()
def restore_timecodes(spark, sf_dir):
    x = twin(spark, sf_dir).withColumns({"start_ms": F.lit(0).cast("long"), "end_ms": F.lit(0).cast("long")})
    return sequence.restore_timecodes(x, cues(spark, sf_dir))


@_query()
def split_long_cues(spark, sf_dir):
    x = cues(spark, sf_dir).withColumn("text", F.replace("text", F.lit(", "), F.lit("，")))
    return sequence.split_cues(x).select("media_id", "seq", "start_ms", "end_ms", "text")


@_query()
def force_split_cues(spark, sf_dir):
    return sequence.split_cues(cues(spark, sf_dir), forced=True).select("media_id", "seq", "start_ms", "end_ms", "text")


@_query(f"""WITH RECURSIVE {CUES_SQL}, every AS (SELECT media_id, seq * 2 AS seq, start_ms, end_ms, text FROM cues UNION ALL SELECT media_id, seq * 2 + 1, start_ms + 100, end_ms, text || '!' FROM cues),
n AS (SELECT *, regexp_replace(text, '[，。、？！,.\\s]', '', 'g') AS key, row_number() {W} AS rn FROM every),
walk AS (SELECT media_id, rn, rn AS k, CAST(0 AS BIGINT) AS dropped FROM n WHERE rn = 1
  UNION ALL SELECT x.media_id, x.rn, CASE WHEN near AND length(x.text) <= length(y.text) THEN w.k ELSE x.rn END, CASE WHEN NOT near THEN 0 WHEN length(x.text) > length(y.text) THEN w.k ELSE x.rn END
  FROM (SELECT w.media_id, w.rn + 1 AS rn, w.k FROM walk w) w JOIN n x ON x.media_id = w.media_id AND x.rn = w.rn JOIN n y ON y.media_id = w.media_id AND y.rn = w.k,
  LATERAL (SELECT abs(x.start_ms - y.start_ms) < 300 AND abs(x.end_ms - y.end_ms) < 300 AND (x.key = y.key OR starts_with(x.key, y.key) OR starts_with(y.key, x.key)) AS near) l)
SELECT n.media_id, n.seq, n.start_ms, n.end_ms, n.text FROM n WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.media_id = n.media_id AND w.dropped = n.rn)""")
def near_dup_time(spark, sf_dir):
    x = cues(spark, sf_dir).select("media_id", (F.col("seq") * 2).alias("seq"), "start_ms", "end_ms", "text")
    again = x.withColumns({"seq": F.col("seq") + 1, "start_ms": F.col("start_ms") + 100, "text": F.concat("text", F.lit("!"))})
    return sequence.near_duplicates(x.unionByName(again))


@_query()
def term_boundary(spark, sf_dir):
    x = cues(spark, sf_dir).select("media_id", "seq", "start_ms", "end_ms", F.regexp_replace("text", "[.]$", "").alias("text"))
    return sequence.terms_kept_whole(x, ["theTh", "ndThe", "ereIn", "enAn"])


@_query()
def clean_pass(spark, sf_dir):
    return passes.clean(cues(spark, sf_dir)).select("media_id", "seq", "start_ms", "end_ms", "text", "deleted")


@_query()
def prepare_pass(spark, sf_dir):
    x = cues(spark, sf_dir)
    caps = x.where("seq % 4 = 0").select("media_id", (F.col("start_ms") / 1000).alias("time_s"), F.col("role").alias("caption"), F.array("role").alias("terms"))
    return passes.prepare(x, twin(spark, sf_dir), caps, 1500, 4).withColumn("blocks", F.array_join("blocks", "\n"))


@_query()
def postprocess_pass(spark, sf_dir):
    x = twin(spark, sf_dir).select("media_id", "seq", "start_ms", "end_ms", "text")
    return passes.postprocess(x, cues(spark, sf_dir), ["theTh"])


@_query("""WITH RECURSIVE e AS (SELECT label AS media_id, vec_id AS seq, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings WHERE embedding IS NOT NULL),
walk AS (SELECT media_id, seq, rn, bits, [bits] AS kept, TRUE AS stays FROM e WHERE rn = 1
  UNION ALL SELECT media_id, seq, rn, bits, CASE WHEN near THEN kept ELSE list_append(kept, bits) END, NOT near FROM (
    SELECT e.media_id, e.seq, e.rn, e.bits, w.kept, coalesce(list_min(list_transform(w.kept, lambda k: list_sum(list_transform(range(1, 65), lambda i: CASE WHEN k[i] <> e.bits[i] THEN 1 ELSE 0 END)))), 64) < 8 AS near
    FROM walk w JOIN e ON e.media_id = w.media_id AND e.rn = w.rn + 1) q)
SELECT media_id, seq, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM (
  SELECT media_id, seq, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN bits[i] = 1 THEN CAST(pow(2, 64 - i) AS HUGEINT) ELSE CAST(0 AS HUGEINT) END)) AS h FROM walk WHERE stays) q""")
def distinct_frames(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").where("embedding is not null")
    # one sign a bit of the hash: vectors of more than 64 dimensions are told apart by their first 64
    bits = F.aggregate(F.expr("transform(slice(embedding, 1, 64), x -> if(x > 0, 1L, 0L))"), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return sequence.distinct_frames(x.select(F.col("label").alias("media_id"), F.col("vec_id").alias("seq"), bits.alias("hash")))


@_query("""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[，,。！？、\\s]', '', 'g') AS s FROM conversations),
g AS (SELECT conv_id, turn, n, substr(s, i, n) AS gram, count(*) AS c FROM (SELECT conv_id, turn, s, n, unnest(range(1, greatest(length(s) - n + 1, 1) + 1)) AS i FROM t, (VALUES (1), (2), (3)) v(n) WHERE length(s) >= 10) q GROUP BY conv_id, turn, n, substr(s, i, n)),
m AS (SELECT conv_id, turn, n, CAST(sum(c) AS BIGINT) AS total, max(c) AS best, arg_max(gram, c) AS gram FROM g GROUP BY conv_id, turn, n),
hit AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) AS r FROM m WHERE best >= 10 AND CAST(best AS DOUBLE) / total >= 0.8)
SELECT t.conv_id, t.turn, CAST(h.n AS INTEGER) AS n, h.gram, CAST(h.best AS INTEGER) AS count, CAST(h.best AS DOUBLE) / h.total AS ratio FROM t LEFT JOIN hit h ON h.conv_id = t.conv_id AND h.turn = t.turn AND h.r = 1""")
def repeated_grams(spark, sf_dir):
    """Every turn, judged by its whole text; nulls where nothing repeats."""
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.repetition("text").alias("r"))
    return x.select("conv_id", "turn", "r.n", "r.gram", "r.count", "r.ratio")


@_query(f"{C} SELECT media_id, seq, start_ms AS parsed_ms, round(CAST(end_ms AS DOUBLE) / 1000, 3) AS parsed_s FROM cues")
def timecode_roundtrip(spark, sf_dir):
    return cues(spark, sf_dir).select("media_id", "seq", tc.parse_ms(tc.format_ms("start_ms")).alias("parsed_ms"), F.round(tc.parse_seconds(tc.format_ms("end_ms")), 3).alias("parsed_s"))


@_query("SELECT conv_id, turn, '[' || CAST(turn AS VARCHAR) || ', ' || CAST(length(text) AS VARCHAR) || ']' AS found FROM conversations WHERE NOT contains(text, '`')")
def fenced_json_turns(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").where("not contains(text, '`')")
    inner = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(", "), F.length("text").cast("string"), F.lit("]"))
    return x.select("conv_id", "turn", tx.fenced_json(F.concat("text", F.lit("\n```json\n"), inner, F.lit("\n```\n"), "role")).alias("found"))


@_query(f"{C} SELECT media_id, row_number() {W} - 1 AS seq, CAST(start_ms AS DOUBLE) / 1000 AS start_s, CAST(end_ms AS DOUBLE) / 1000 AS end_s, text FROM cues")
def segment_json_roundtrip(spark, sf_dir):
    row = F.struct("seq", (F.col("start_ms") / 1000).alias("Start"), (F.col("end_ms") / 1000).alias("end"), F.col("text").alias("Content"))
    x = cues(spark, sf_dir).groupBy("media_id").agg(F.sort_array(F.collect_list(row)).alias("l"))
    content = F.to_json(F.struct(F.transform("l", lambda z: F.struct(z["Start"].alias("Start"), z["end"].alias("end"), z["Content"].alias("Content"))).alias("segments")))
    return srt.scan_segments(x.select("media_id", content.alias("content"))).select("media_id", "seq", "start_s", "end_s", "text")


# literal cases: texts outside the tables' languages, compared with their expected rows


def _values(rows: list[tuple], columns: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) v({columns})"


def _literal(name: str, cases: list[tuple[str, object]], make: Callable, kind: str = "string") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "case_no int, given string")
        return x.select("case_no", make(F.col("given")).cast(kind).alias("result"))

    _QUERIES[name] = run
    _SQL[name] = "SELECT CAST(case_no AS INTEGER) AS case_no, " + {"string": "result", "long": "CAST(result AS BIGINT) AS result", "boolean": "CAST(result AS BOOLEAN) AS result", "double": "CAST(result AS DOUBLE) AS result"}[kind] + f" FROM ({_values([(i, c[1]) for i, c in enumerate(cases)], 'case_no, result')}) q"


_literal("fullwidth_norm", [("AWS, Google", "AWS，Google"), ("賺2,200元", "賺2,200元"), ("今天好?", "今天好？"), ("WTF!", "WTF!"), ("好 !", "好 ！"), ("10:00, 3.5", "10:00, 3.5"), ("a, 5", "a， 5"), ("", "")], tx.fullwidth_norm)
_literal("half_to_full", [("你好,世界", "你好，世界"), ("a,b", "a,b"), ("好.", "好。"), ("ok:好", "ok：好"), ("3.5", "3.5")], tx.half_to_full)
_literal("commas_widened", [("3,000", "3，000"), (_block(1, 1, ""), _block(1, 1, ""))], tx.widen_commas)
_literal("latin_to_half", [("ＡＷＳ１２，好", "AWS12，好"), ("abc", "abc")], tx.latin_to_half)
_literal("dup_keys", [("今天, 大盤_好!", "今天大盤好"), ("A-b 1", "Ab1")], tx.dup_key)
_literal("trailing_punct", [("好。", "好"), ("好，。.", "好"), ("a.b", "a.b")], tx.strip_trailing_punct)
_literal("inline_fillers", [("好，我們開始", "我們開始"), ("好我們開始", "我們開始"), ("那這個很重要", "這個很重要"), ("走啦", "走"), ("好人", "好人")], tx.delete_inline_fillers)
_literal("standalone_fillers", [("嗯", True), (" OK ", True), ("嗯哼", False)], tx.is_standalone_filler, "boolean")
_literal("commentary_lines", [("→ 不改", True), ("[確認]", True), ("此條通順", True), ("今天大盤", False), ("", False)], tx.is_commentary, "boolean")
_literal("tag_residue", [("那這種</content></invoke>", "那這種"), ("好<", "好"), ("content>好", "好"), ('name="x">好', "好"), ("AAPL>", "AAPL>")], tx.strip_tag_residue)
_literal("terminology", [("用aws跑", "用AWS跑"), ("paws", "paws"), ("Chat gpt好", "ChatGPT好")], lambda c: tx.terminology(c, {"aws": "AWS", "chat gpt": "ChatGPT"}))
_literal("repeated_run", [("啊啊啊啊啊啊啊啊啊啊", True), ("啊啊啊", False)], tx.repeated_run, "boolean")
_literal("script_conversion", [("头发和发展", "頭髮和發展"), ("云", "雲")], lambda c: tx.convert_phrases(c, {"头发": "頭髮"}, {"发": "發", "云": "雲"}))
_literal("mid_word_commas", [("沒辦，法", "沒辦法"), ("比較，大家", "比較，大家"), ("好，走", "好，走")], lambda c: tx.cjk_commas_repaired(c, {"辦法": 900, "較大": 800, "比較": 2000}))
_literal("fenced_json", [('x ```json\n[1]\n``` y', "[1]"), ("see [2] end", "[2]"), ("plain", "plain")], tx.fenced_json)
_RULED = [("四指軍線", "市值均線"), ("農機具展", "農機具展"), ("新機具", "新級距"), ("今天排斥", "今天盤勢"), ("排斥他", "排斥他")]


@_query(_values([(i, w) for i, (_, w) in enumerate(_RULED)], "seq, text"))
def cjk_rules(spark, sf_dir):
    x = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(_RULED)], "seq int, text string")
    return rules.fold(x, rules.SAMPLE_RULES)


@_query(_values([(0, "軍線", 2), (1, "排斥", 2)], "seq, wrong, hit"))
def missed_rules(spark, sf_dir):
    x = spark.createDataFrame([("m", 0, 0, "今天軍線"), ("m", 1, 0, "大盤排斥"), ("m", 2, 0, "排斥他"), ("m", 3, 0, "農機具")], "media_id string, seq int, start_ms int, text string")
    return rules.scan_missed(x, rules.SAMPLE_RULES).select("seq", "wrong", F.col("at").alias("hit"))


_literal("noise_pairs", [("他|她", True), ("Aws|AWS", True), ("，|。", True), ("四指|市值", False), ("|x", True)], lambda c: tx.is_noise(F.split(c, "\\|")[0], F.split(c, "\\|")[1]), "boolean")
_literal("destinations", [("四指", "preprocess"), ("aws", "terms"), ("長", "terms")], tx.suggest_destination)
_literal("timecode_parse", [("00:00:01,500", 1500), ("1:02:03.4", 3723004), ("00:00:05", 5000), ("x", None)], tc.parse_ms, "long")
_literal("timecode_seconds", [("00:00:01,5", 1.5), ("00:01:00", 60.0)], tc.parse_seconds, "double")
_literal("timecode_rounding", [("0.0025", "00:00:00,002"), ("3661.0015", "01:01:01,002")], lambda c: tc.format_seconds_rounded(c.cast("double")))
_literal("timecode_truncation", [("0.0029", "00:00:00,002"), ("59.9999", "00:00:59,999")], lambda c: tc.format_seconds_truncated(c.cast("double")))


@_query(f"{C} SELECT media_id, seq, {_stamp('start_ms')} AS stamp, {_clock('end_ms')} AS clock FROM cues")
def timecode_format(spark, sf_dir):
    return cues(spark, sf_dir).select("media_id", "seq", tc.format_ms("start_ms").alias("stamp"), tc.format_clock("end_ms").alias("clock"))


@_query(f"{C} SELECT CAST(media_id AS VARCHAR) AS media_id, row_number() {W} - 1 AS seq, row_number() {W} AS idx, start_ms, end_ms, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM cues WHERE NOT regexp_matches(text, '\\n\\s*\\n')")
def srt_roundtrip(spark, sf_dir):
    x = cues(spark, sf_dir).where(~F.col("text").rlike(r"\n\s*\n")).withColumn("media_id", F.col("media_id").cast("string"))
    return srt.scan_srt(sinks.render_srt(x))


@_query(f"{C} SELECT CAST(media_id AS VARCHAR) AS media_id, row_number() {W} - 1 AS seq, start_ms, end_ms, trim(split_part(text, chr(10), 1)) AS text FROM cues WHERE trim(split_part(text, chr(10), 1)) <> ''")
def log_reconstruct(spark, sf_dir):
    stamp = lambda c: F.replace(tc.format_ms(c), F.lit(","), F.lit("."))
    line = F.concat(F.lit("["), stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.lit("] "), "text")  # further lines of a turn have no stamp and aren't part of a cue
    x = cues(spark, sf_dir).groupBy(F.col("media_id").cast("string").alias("media_id")).agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("l")))).alias("l"))
    return srt.scan_log(x.select("media_id", F.concat(F.array_join(F.transform("l", lambda z: z["l"]), "\n"), F.lit("\nTraceback (most recent call last):\n[00:01.000 --> 00:02.000] gone")).alias("content")))


@_query(f"{C}, b AS (SELECT CAST(media_id AS VARCHAR) AS media_id, seq, row_number() {W} AS rn, end_ms - CASE WHEN seq = 4 THEN end_ms - start_ms ELSE 0 END > start_ms AS ok FROM cues), f AS (SELECT media_id, min(rn) FILTER (WHERE NOT ok) AS bad, count(*) AS n FROM b GROUP BY media_id) SELECT media_id, bad IS NULL AS valid, coalesce(bad - 1, n) AS n, CASE WHEN bad IS NULL THEN '' ELSE 'bad block' END AS reason FROM f")
def strict_validate(spark, sf_dir):
    x = cues(spark, sf_dir).select(F.col("media_id").cast("string").alias("media_id"), "seq", "start_ms", F.when(F.col("seq") == 4, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"), F.lit("x").alias("text"))
    return validate.validate_srt(sinks.render_srt(x))


_BLOCKS = "\n\n".join(_block(i, i, t) for i, t in enumerate(("今天\n→ 不改", "「好", "[確認]", "走</invoke>"), 1))


@_query(_values([(0, "A", "今天", 1), (1, "C", "「好", None), (2, "B", "", None), (3, "A", "走", 2)], "block_seq, action, text, idx"))
def commentary_clean(spark, sf_dir):
    x = commentary.clean(srt.scan_blocks(spark.createDataFrame([("m", _BLOCKS)], "media_id string, content string")))
    return x.select("block_seq", "action", F.array_join("text_lines", "\n").alias("text"), F.col("idx").cast("int").alias("idx"))


@_query("SELECT seq, CAST(start_s AS DOUBLE) AS start_s, CAST(end_s AS DOUBLE) AS end_s, text FROM (" + _values([(0, 1.0, 2.0, "a"), (1, 3.0, 4.5, "b")], "seq, start_s, end_s, text") + ") q")
def segment_json_scan(spark, sf_dir):
    x = srt.scan_segments(spark.createDataFrame([("m", '{"segments":[{"Content":"a","End":2.0,"Start":1.0},{"text":"b","end":4.5,"start":3.0}]}')], "media_id string, content string"))
    return x.select(F.col("seq").cast("int").alias("seq"), "start_s", "end_s", "text")


@_query(_values([("f1", "慢", "AWS,市值", True), ("f2", None, "", False)], "frame, caption, terms, ok"))
def vlm_parse(spark, sf_dir):
    raw = [("m", "f1", 1.0, '```json\n{"caption":"慢","terms":["市值"],"tickers":["AWS"]}\n```'), ("m", "f2", 2.0, "no json")]
    x = external.parse_vlm(spark.createDataFrame(raw, "media_id string, frame string, frame_time double, raw string"))
    return x.select("frame", "caption", F.array_join("terms", ",").alias("terms"), "ok")


@_query(_values([("srt", "ready"), ("json", "missing"), ("vv", "stale"), ("cap", "invalid")], "type, status"))
def stage_status(spark, sf_dir):
    at = lambda h: F.timestamp_seconds(F.lit(h * 3600))
    every = spark.createDataFrame([("m", t) for t in ("srt", "json", "vv", "cap")], "media_id string, type string")
    found = every.where("type != 'json'").withColumns({"modified": F.when(F.col("type") == "vv", at(1)).otherwise(at(9)), "size": F.when(F.col("type") == "cap", 0).otherwise(5)})
    marks = every.select("media_id").distinct().withColumn("launched", at(5))
    return validate.stage_status(every, found, marks, every.withColumn("valid", F.lit(True))).select("type", "status")

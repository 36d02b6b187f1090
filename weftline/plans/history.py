"""Queries over session history, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.shell import with_shell_features
from ..operators import brief as B
from ..operators import entries as E
from ..operators import search as R
from ..operators import sections as X
from ..operators import summary as Y
from ..sources import tables as S
from ..sources.checkpoints import cut, new_folder

CWD = "/work/app"
A1 = S.MESSAGES_SQL.strip()
A2 = S.TOOL_LOG_SQL.strip()


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.indexed(E.to_entries(S.messages(spark, sf_dir)))


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the tool log without ids, which most queries don't look at."""
    return E.indexed(E.cleaned(S.tool_messages(spark, sf_dir)).drop("called"))


def named_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the tool log with ids."""
    return E.indexed(E.to_entries(S.tool_messages(spark, sf_dir)))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("term"))
    hits = R.bm25(S.spread(S.table(spark, sf_dir, "documents").select("doc_id", "text")), queries, ["doc_id"], [])
    return R.top(hits, [F.desc("score"), F.col("doc_id")]).select("query_id", "doc_id", "score", "rank")


def bm25_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from postings that three batches have left; a fourth one has come and gone."""
    docs = S.spread(S.table(spark, sf_dir, "documents").select("doc_id", "text"))
    queries = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("term"))
    folder = new_folder(spark, "postings")
    gone = docs.where("doc_id % 11 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    for batch, (part, removed) in enumerate([(docs.where("doc_id % 3 = 0"), False), (gone, False), (docs.where("doc_id % 3 = 1"), False), (docs.where("doc_id % 3 = 2"), False), (gone, True)]):
        R.keep_postings(part, folder, batch, ["doc_id"], [], removed=removed)
    hits = R.bm25_kept(spark, folder, queries, ["doc_id"], [])
    return R.top(hits, [F.desc("score"), F.col("doc_id")]).select("query_id", "doc_id", "score", "rank")


def _tokens_sql(text: str) -> str:
    whole = r"regexp_replace(w, '^[.\-/]+|[.\-/]+$', '', 'g')"
    return rf"""flatten(list_transform(regexp_extract_all(lower({text}), '[a-z0-9_$.\-/]{{2,}}'), lambda w: list_concat(
      list_filter([{whole}], lambda a: length(a) >= 2),
      list_filter(string_split_regex({whole}, '[.\-/_]+'), lambda p: length(p) >= 2 AND p <> {whole}))))"""


BM25_SQL = f"""
WITH d AS (SELECT doc_id, {_tokens_sql("text")} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_tokens_sql("text")})) AS term FROM benchmark),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 8
"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).select("session_id", "ord", "role", "text", "index", "entry_id")


ENTRIES_SQL = rf"""
WITH RECURSIVE t AS (SELECT session_id, ord, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM ({A1})),
m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS index FROM t WHERE text <> ''),
k AS (SELECT *, substr(role, 1, 1) || ':' || md5(chr(10) || md5(text)) AS key FROM m WHERE index = 0
  UNION ALL SELECT m.*, substr(m.role, 1, 1) || ':' || md5(k.key || chr(10) || md5(m.text)) FROM k JOIN m ON m.session_id = k.session_id AND m.index = k.index + 1)
SELECT session_id, ord, role, text, index, substr(md5(key), 1, 12) AS entry_id FROM k
"""


def archive_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of an archive that holds the first turns and a live window that begins anew with all."""
    live = talk(spark, sf_dir)
    archive = live.where("ord <= 3").withColumn("origin", F.lit("archive"))
    return E.corpus(archive, live.drop("index").withColumn("origin", F.lit("live"))).select("session_id", "entry_id", "index", "origin")


ARCHIVE_SQL = f"SELECT session_id, entry_id, index, CASE WHEN ord <= 3 THEN 'archive' ELSE 'live' END AS origin FROM ({ENTRIES_SQL})"


def window_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the corpus whose key is in a live window that begins after the first ones."""
    whole = named_work(spark, sf_dir)
    return E.in_window(whole, whole.where("ord >= 20 and role = 'assistant'")).select("session_id", "ord", "role")


WINDOW_SQL = f"SELECT session_id, ord, role FROM ({A2}) WHERE ord >= 20 AND role = 'assistant'"


def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = talk(spark, sf_dir)
    return E.new_entries(live, live.where("ord <= 3")).select("session_id", "ord", "entry_id")


NEW_SQL = f"SELECT session_id, ord, entry_id FROM ({ENTRIES_SQL}) WHERE ord > 3"


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return S.spread(S.table(spark, sf_dir, "documents")).select(
        "doc_id", T.estimate_tokens(t).alias("tokens"), T.has_cjk(t).alias("cjk"), T.clip(t, 100).alias("clipped"), T.clip_sentence(t, 200).alias("sentence"), T.clip_tokens(t, 50).alias("few_tokens"),
        T.first_line(t, 80).alias("first_line"), F.size(T.non_empty_lines(t)).alias("n_lines"), T.one_line(t).alias("one_line"), T.hash_id(t).alias("hash"), F.size(T.search_tokens(t)).alias("n_terms"),
    )


_clip = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE substr({x}, 1, {n - 1}) || '…' END"
_last = lambda e: f"CASE WHEN strpos(reverse(substr(text, 1, 200)), '{e[::-1]}') > 0 THEN 199 - strpos(reverse(substr(text, 1, 200)), '{e[::-1]}') ELSE -1 END"
_lines = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
SCALARS_SQL = rf"""
WITH d AS (SELECT doc_id, text, coalesce({_lines}[1], '') AS l1, len({_lines}) AS n, trim(regexp_replace(text, '\s+', ' ', 'g')) AS o,
  greatest({_last(". ")}, {_last("! ")}, {_last("? ")}) AS cut FROM documents)
SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, false AS cjk, {_clip("text", 100)} AS clipped,
  CASE WHEN length(text) <= 200 THEN text WHEN cut > 100 THEN substr(text, 1, cut + 1) ELSE {_clip("text", 200)} END AS sentence,
  CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || '…' END AS few_tokens,
  {_clip("l1", 80)} AS first_line, n AS n_lines, {_clip("o", 400)} AS one_line, substr(md5(text), 1, 12) AS hash, len({_tokens_sql("text")}) AS n_terms
FROM d
"""


def token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.message_tokens(S.messages(spark, sf_dir))


TOKENS_SQL = f"SELECT session_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM ({A1}) GROUP BY session_id"


def noise_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With reads taken as noise."""
    return E.without_noise(work(spark, sf_dir), ["Read"]).select("session_id", "ord", "role", F.size("tools").alias("n_tools"))


NOISE_SQL = f"SELECT session_id, ord, role, CASE WHEN tool IS NULL OR tool = 'Read' THEN 0 ELSE 1 END AS n_tools FROM ({A2}) WHERE text <> '' OR tool <> 'Read'"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tool_calls(work(spark, sf_dir))


def tool_one_liners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("session_id", "ord", T.tool_line(F.col("name"), F.col("input"), CWD).alias("line"))


LINERS_SQL = f"SELECT session_id, ord, tool || ': ' || coalesce(command, replace(file_path, '/work/app/', '')) AS line FROM ({A2}) WHERE tool IS NOT NULL"


def shell_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_shell_features(calls(spark, sf_dir).where("command is not null"))
    return found.groupBy("session_id", "command_key", "read_only").agg(F.count("*").alias("n_calls"), F.sum(F.size("writes")).alias("n_writes"))


_key = "CASE WHEN command LIKE 'grep%' THEN 'grep' WHEN command LIKE 'git%' THEN 'git commit' WHEN command LIKE 'pnpm%' THEN 'pnpm test' END"
SHELL_SQL = f"SELECT session_id, {_key} AS command_key, command LIKE 'grep%' AS read_only, count(*) AS n_calls, CAST(0 AS BIGINT) AS n_writes FROM ({A2}) WHERE command IS NOT NULL GROUP BY ALL"


_commands = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'echo x > out/m' || event_id || '.txt' WHEN 1 THEN 'sed -i s/a/b/ src/m' || event_id || '.ts' WHEN 2 THEN 'cd src && cat m.ts | tee log/m' || event_id || '.log'
  WHEN 3 THEN 'cd /work/app && printf y >> notes' || event_id || '.md' WHEN 4 THEN 'ls -l src | head' ELSE 'npm test 2> /dev/null' END AS command FROM events
"""


def shell_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that redirect, edit in place, split output, change folders, only read, and discard what they print."""
    found = with_shell_features(S.adapted(spark, sf_dir, _commands, "events"))
    return found.select("event_id", "command_key", "read_only", F.array_join("writes", ",").alias("writes"))


WRITES_SQL = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'echo x' WHEN 1 THEN 'sed' WHEN 2 THEN 'cat' WHEN 3 THEN 'printf y' WHEN 4 THEN 'ls' ELSE 'npm test' END AS command_key, event_id % 6 = 4 AS read_only,
  CASE event_id % 6 WHEN 0 THEN 'out/m' || event_id || '.txt' WHEN 1 THEN 'src/m' || event_id || '.ts' WHEN 2 THEN 'log/m' || event_id || '.log' WHEN 3 THEN '/work/app/notes' || event_id || '.md' ELSE '' END AS writes FROM events
"""


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in terminal colours and a host's wrapper, those of even ids after three CJK characters."""
    cjk = F.when(F.col("doc_id") % 2 == 0, "直して").otherwise("")
    marked = F.concat(F.lit("\x1b[1;31m"), F.lit("<system-reminder>not the\nuser's</system-reminder> \x07"), cjk, "text", F.lit("\x1b[0m"))
    t = F.col("t")
    rows = S.table(spark, sf_dir, "documents").select("doc_id", T.strip_wrappers(T.sanitize(marked)).alias("t"))
    return rows.select("doc_id", F.md5(t).alias("digest"), T.has_cjk(t).alias("cjk"), T.estimate_tokens(t).alias("tokens"), T.clip_tokens(t, 50).alias("few_tokens"), F.size(T.search_tokens(t)).alias("n_terms"))


MARKED_SQL = rf"""
WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS cjk, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '直して' ELSE '' END || text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(t) AS digest, cjk, CAST(ceil((length(t) + CASE WHEN cjk THEN 9 ELSE 0 END) / 4.0) AS BIGINT) AS tokens,
  CASE WHEN length(t) + CASE WHEN cjk THEN 9 ELSE 0 END <= 200 THEN t ELSE substr(t, 1, CASE WHEN cjk THEN 191 ELSE 200 END) || '…' END AS few_tokens, len({_tokens_sql("t")}) + CASE WHEN cjk THEN 2 ELSE 0 END AS n_terms FROM d
"""


def tool_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tool_folds(work(spark, sf_dir)).select("session_id", "island", F.col("n").alias("n_calls"), "failed", "line")


FOLD_SQL = f"""
WITH m AS (SELECT *, sum(CASE WHEN role = 'user' OR text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ({A2})),
t AS (SELECT session_id, island, tool, count(*) AS n, sum(CAST(is_error AS INT)) AS f, min(ord) AS o, min(ord) AS lo, max(ord) AS hi FROM m WHERE tool IS NOT NULL GROUP BY ALL),
g AS (SELECT session_id, island, sum(n) AS n, sum(f) AS f, min(lo) AS lo, max(hi) AS hi, string_agg(tool || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END, ', ' ORDER BY o) AS names FROM t GROUP BY ALL)
SELECT session_id, CAST(island AS BIGINT) AS island, CAST(n AS BIGINT) AS n_calls, CAST(f AS BIGINT) AS failed,
  '  (' || CAST(n AS BIGINT) || CASE WHEN n > 1 THEN ' tool calls' ELSE ' tool call' END || ' #' || lo || CASE WHEN hi > lo THEN '–#' || hi ELSE '' END || ': ' || names || CASE WHEN f > 0 THEN '; ' || CAST(f AS BIGINT) || ' failed' ELSE '' END || ')' AS line
FROM g
"""


def brief_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.brief_tail(work(spark, sf_dir)).select("session_id", F.array_join("brief", "\n").alias("brief"))


#: Sessions are shorter than the caps on lines.
BRIEF_SQL = f"""
WITH m AS (SELECT *, sum(CASE WHEN role = 'user' OR text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ({A2})),
l AS (SELECT session_id, island, 0 AS part, '[' || role || ' #' || ord || '] ' || CASE WHEN text LIKE '<task-notification>%' THEN 'task notification: ' || regexp_extract(text, '<summary>(.*)</summary>', 1) ELSE text END AS line
    FROM m WHERE role = 'user' OR text <> '' UNION ALL SELECT session_id, island, 1, line FROM ({FOLD_SQL}))
SELECT session_id, string_agg(line, chr(10) ORDER BY island, part) AS brief FROM l GROUP BY session_id
"""


def files_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.file_status(calls(spark, sf_dir), CWD).select("session_id", "path", "status", F.col("at.ord").alias("first_ord"))


FILES_SQL = f"""
WITH c AS (SELECT session_id, replace(file_path, '/work/app/', '') AS path, ord, CASE WHEN tool = 'Read' THEN 'Read' WHEN tool = 'Write' AND result LIKE '%created successfully%' THEN 'Created' ELSE 'Modified' END AS s
  FROM ({A2}) WHERE file_path IS NOT NULL AND NOT is_error),
g AS (SELECT session_id, path, min(ord) FILTER (s = 'Modified') AS m, min(ord) FILTER (s = 'Created') AS c, min(ord) FILTER (s = 'Read') AS r FROM c GROUP BY ALL)
SELECT session_id, path, CASE WHEN m IS NOT NULL THEN 'Modified' WHEN c IS NOT NULL THEN 'Created' ELSE 'Read' END AS status, coalesce(m, c, r) AS first_ord FROM g
"""


def open_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.open_errors(calls(spark, sf_dir)).select("session_id", F.col("at.ord").alias("ord"), "line")


ERRORS_SQL = f"""
WITH c AS (SELECT *, {_key} AS key FROM ({A2}) WHERE tool IS NOT NULL)
SELECT session_id, ord, '[' || tool || '] ' || regexp_replace(result, '^Exit code [0-9]+.', '', 's') AS line FROM c e
WHERE is_error AND NOT EXISTS (SELECT 1 FROM c s WHERE s.session_id = e.session_id AND NOT s.is_error AND s.ord > e.ord AND s.tool = e.tool
  AND CASE WHEN e.tool = 'Bash' THEN e.key = 'grep' OR s.command = e.command OR s.key = e.key ELSE s.file_path = e.file_path END)
"""


def outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.outstanding(work(spark, sf_dir)).select("session_id", F.array_join("outstanding", "\n").alias("outstanding"))


OUTSTANDING_SQL = f"""
WITH b AS (SELECT *, {_key} AS key, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS back FROM ({A2})),
c AS (SELECT * FROM b WHERE back <= 60),
l AS (SELECT session_id, ord, '[' || tool || '] ' || regexp_replace(result, '^Exit code [0-9]+.', '', 's') AS line FROM c e
  WHERE is_error AND NOT EXISTS (SELECT 1 FROM c s WHERE s.session_id = e.session_id AND NOT s.is_error AND s.ord > e.ord AND s.tool = e.tool
    AND CASE WHEN e.tool = 'Bash' THEN e.key = 'grep' OR s.command = e.command OR s.key = e.key ELSE s.file_path = e.file_path END)
  UNION ALL SELECT session_id, ord, '[user] ' || text FROM c WHERE role = 'user' AND text LIKE 'The nightly build is still failing%'),
u AS (SELECT session_id, line, min(ord) AS ord FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS n FROM u)
SELECT session_id, string_agg(line, chr(10) ORDER BY ord) AS outstanding FROM r WHERE n <= 5 GROUP BY session_id
"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.commits(calls(spark, sf_dir)).select("session_id", F.array_join("commits", "\n").alias("commits"))


COMMITS_SQL = rf"""
WITH c AS (SELECT session_id, ord, regexp_extract(command, '-m "([^"]+)"', 1) AS m, regexp_extract(result, '\[main ([0-9a-f]+)\]', 1) AS h FROM ({A2}) WHERE command LIKE 'git commit%' AND NOT is_error),
u AS (SELECT session_id, CASE WHEN h <> '' THEN h || ' ' ELSE '' END || m AS line, min(ord) AS ord FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS n FROM u)
SELECT session_id, string_agg(line, chr(10) ORDER BY ord) AS commits FROM r WHERE n <= 8 GROUP BY session_id
"""


def session_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.goals(work(spark, sf_dir)).select("session_id", F.array_join("goals", "\n").alias("goals"))


GOALS_SQL = f"""
WITH u AS (SELECT session_id, ord, text, min(ord) OVER (PARTITION BY session_id) AS f FROM ({A2}) WHERE role = 'user' AND text <> 'go'),
g AS (SELECT session_id, min_by(text || ' (#' || ord || ')', ord) AS s, max_by('[Scope change] ' || text || ' (#' || ord || ')', ord) FILTER (ord > f AND regexp_matches(text, '^(Instead|Please add|The nightly build)')) AS c FROM u GROUP BY session_id)
SELECT session_id, concat_ws(chr(10), s, c) AS goals FROM g
"""


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = work(spark, sf_dir)
    return X.without_goals(X.preferences(clean), X.goals(clean)).select("session_id", F.array_join("preferences", "\n").alias("preferences"))


PREFERENCES_SQL = f"""
WITH u AS (SELECT session_id, text, min(ord) AS ord FROM ({A2}) WHERE text LIKE 'always use%' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS n FROM u),
g AS (SELECT session_id, min(ord) AS f FROM ({A2}) WHERE role = 'user' AND text <> 'go' GROUP BY session_id)
SELECT session_id, coalesce(string_agg(text || ' (#' || ord || ')', chr(10) ORDER BY ord) FILTER (ord <> f), '') AS preferences FROM r JOIN g USING (session_id) WHERE n <= 10 GROUP BY session_id
"""


def user_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.user_reports(work(spark, sf_dir)).select("session_id", F.col("at.ord").alias("ord"), "line")


REPORTS_SQL = f"SELECT session_id, min(ord) AS ord, '[user] ' || text AS line FROM ({A2}) WHERE text LIKE 'The nightly build is still failing%' GROUP BY session_id, text"


def last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.last_state(work(spark, sf_dir)).select("session_id", F.col("user.index").alias("user_index"), F.col("proposal.index").alias("proposal_index"), F.col("request.index").alias("request_index"), F.col("reply.index").alias("reply_index"))


STATE_SQL = f"""
WITH m AS (SELECT *, max(ord) FILTER (role = 'user') OVER (PARTITION BY session_id) AS u FROM ({A2}))
SELECT session_id, max(u) AS user_index, max(ord) FILTER (role = 'assistant' AND text <> '' AND ord < u) AS proposal_index,
  max(ord) FILTER (role = 'user' AND ord < u AND length(text) > 40 AND text NOT LIKE '<task-notification>%') AS request_index,
  max(ord) FILTER (role = 'assistant' AND text <> '' AND (u IS NULL OR ord > u)) AS reply_index FROM m GROUP BY session_id
"""


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.current_state(work(spark, sf_dir), CWD).select("session_id", F.array_join("current_state", "\n").alias("current_state"))


_tells = lambda t: f"CASE WHEN {t} LIKE '<task-notification>%' THEN 'task notification: ' || regexp_extract({t}, '<summary>(.*)</summary>', 1) ELSE {t} END"
CURRENT_SQL = f"""
WITH a AS ({A2}), s AS ({STATE_SQL}),
t AS (SELECT s.*, u.text AS ut, u.text LIKE '<task-notification>%' AS notified, u.text LIKE '<task-notification>%' OR length(u.text) <= 40 AS weak, p.text AS pt, r.text AS rt, q.text AS qt FROM s
  LEFT JOIN a u ON u.session_id = s.session_id AND u.ord = user_index LEFT JOIN a p ON p.session_id = s.session_id AND p.ord = proposal_index
  LEFT JOIN a r ON r.session_id = s.session_id AND r.ord = request_index LEFT JOIN a q ON q.session_id = s.session_id AND q.ord = reply_index),
c AS (SELECT a.*, {_key} AS key, row_number() OVER (PARTITION BY a.session_id ORDER BY ord DESC) AS back FROM a JOIN t USING (session_id)
  WHERE tool IS NOT NULL AND CASE WHEN reply_index IS NOT NULL THEN ord >= reply_index ELSE user_index IS NULL OR ord > user_index END),
l AS (SELECT session_id, 1 AS n, CASE WHEN notified THEN 'Last event (#' ELSE 'Last user request (#' END || user_index || '): ' || {_tells("ut")} AS line FROM t
  UNION ALL SELECT session_id, 2, 'It answers the assistant''s message (#' || proposal_index || '): ' || pt FROM t WHERE weak
  UNION ALL SELECT session_id, 3, 'Last substantive request (#' || request_index || '): ' || rt FROM t WHERE weak
  UNION ALL SELECT session_id, 4, 'Last assistant reply (#' || reply_index || '): ' || qt FROM t
  UNION ALL SELECT session_id, 20 - back, 'Then: ' || tool || ': ' || coalesce(command, replace(file_path, '/work/app/', '')) || CASE WHEN is_error THEN ' → [tool_error] ' || regexp_replace(result, '^Exit code [0-9]+.', '', 's')
    WHEN back <= 3 AND tool = 'Bash' AND key <> 'grep' THEN ' → ' || result ELSE '' END FROM c WHERE back <= 8)
SELECT session_id, coalesce(string_agg(line, chr(10) ORDER BY n), '') AS current_state FROM l WHERE line IS NOT NULL GROUP BY session_id
"""


def sections_sql(rows: str) -> str:
    """The sections of tool log rows (a query with the adapter's columns), lists of lines and paths."""
    lines = lambda sql, c: f"(SELECT session_id, list_filter(string_split({c}, chr(10)), lambda x: x <> '') AS {c} FROM ({sql.replace(A2, rows)}))"
    paths = ", ".join(f"coalesce(list(path ORDER BY first_ord, path) FILTER (status = '{k}'), []) AS {k.lower()}" for k in P.FILES_MAX)
    parts = [lines(GOALS_SQL, "goals"), f"(SELECT session_id, {paths} FROM ({FILES_SQL.replace(A2, rows)}) GROUP BY session_id)", lines(COMMITS_SQL, "commits"), lines(OUTSTANDING_SQL, "outstanding"), lines(PREFERENCES_SQL, "preferences"), lines(CURRENT_SQL, "current_state"), lines(BRIEF_SQL, "brief")]
    columns = ", ".join(f"coalesce({c}, []) AS {c}" for c in [*map(str.lower, P.FILES_MAX), *Y.LISTS])
    return f"SELECT session_id, {columns} FROM (SELECT DISTINCT session_id FROM ({rows})) " + " ".join(f"LEFT JOIN {x} USING (session_id)" for x in parts)


def merged_sql(first: str, second: str) -> str:
    """Two steps' sections as one."""
    once = lambda a, b, most: f"list_filter(list_concat(a.{a}, b.{b}), lambda x, i: list_position(list_transform(list_concat(a.{a}, b.{b}), lambda y: lower(y)), lower(x)) = i)[-{most}:]"
    both = lambda c: f"list_filter(list_concat(a.{c}, b.{c}), lambda x, i: list_position(list_concat(a.{c}, b.{c}), x) = i)"
    new = [*map(str.lower, P.FILES_MAX), *Y.LISTS]
    old = lambda c: f"coalesce(a.{c}, []) AS {c}"
    return f"""
SELECT session_id, {both("modified")}[-20:] AS modified, list_filter({both("created")}, lambda p: NOT list_contains({both("modified")}, p))[-20:] AS created,
  list_filter({both("read")}, lambda p: NOT list_contains({both("modified")}, p) AND NOT list_contains({both("created")}, p))[-10:] AS read,
  CASE WHEN len(list_filter(b.goals, lambda g: starts_with(g, '[Scope change]'))) > 0 THEN list_concat(list_filter(CASE WHEN len(a.goals) > 0 THEN a.goals ELSE b.goals END, lambda g: NOT starts_with(g, '[Scope change]')), list_filter(b.goals, lambda g: starts_with(g, '[Scope change]')))
    WHEN len(a.goals) > 0 THEN a.goals ELSE b.goals END AS goals,
  {once("commits", "commits", P.COMMITS_MAX)} AS commits, CASE WHEN len(b.outstanding) > 0 THEN b.outstanding ELSE a.outstanding END AS outstanding,
  {once("preferences", "preferences", P.PREFS_MERGED_MAX)} AS preferences, CASE WHEN len(b.current_state) > 0 THEN b.current_state ELSE a.current_state END AS current_state, list_concat(a.brief, b.brief) AS brief
FROM (SELECT session_id, {", ".join(map(old, new))} FROM (SELECT session_id FROM ({first}) UNION SELECT session_id FROM ({second})) LEFT JOIN ({first}) a USING (session_id)) a
JOIN (SELECT session_id, {", ".join(old(c).replace("a.", "b.") for c in new)} FROM (SELECT session_id FROM ({first}) UNION SELECT session_id FROM ({second})) LEFT JOIN ({second}) b USING (session_id)) b USING (session_id)
"""


def summary_sql(sections: str, instructions: str = "") -> str:
    """The summary of sections."""
    block = lambda title, c: f"CASE WHEN len({c}) > 0 THEN '[{title}]' || chr(10) || array_to_string(list_transform({c}, lambda x: '- ' || x), chr(10)) END"
    files = "list_filter([" + ", ".join(f"CASE WHEN len({k.lower()}) > 0 THEN '{k}: ' || array_to_string({k.lower()}[1:{n}], ', ') || CASE WHEN len({k.lower()}) > {n} THEN ' (+' || (len({k.lower()}) - {n}) || ' more)' ELSE '' END END" for k, n in P.FILES_MAX.items()) + "], lambda x: x IS NOT NULL)"
    blocks = [block("Session Goal", "goals"), block("Files And Changes", files), block("Commits", "commits"), block("Outstanding Context", "outstanding"), block("User Preferences", "preferences")]
    brief = "CASE WHEN len(brief) > 0 THEN '[Brief Transcript]' || chr(10) || array_to_string(brief, chr(10)) END"
    told = f"'[Compaction Instructions]' || chr(10) || '{instructions}'" if instructions else "NULL"
    head = f"'{P.SENTINEL}' || chr(10) || 'This session goes on from an earlier conversation, condensed below; entries are numbered #N.'"
    parts = [head, told, f"nullif(concat_ws(chr(10) || chr(10), {', '.join(blocks)}), '')", brief, block("Current State", "current_state"), f"'{Y.RECALL_NOTE}'"]
    return f"SELECT session_id, concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), {', '.join(parts)}) AS summary FROM ({sections})"


_early, _late = f"SELECT * FROM ({A2}) WHERE ord < 30", f"SELECT * FROM ({A2}) WHERE ord >= 30"
STEPS_SQL = merged_sql(sections_sql(_early), sections_sql(_late))
_shown = lambda c: f"array_to_string({c}, chr(10)) AS {c}"
_by_status = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN len({k.lower()}) > 0 THEN '{k}: ' || array_to_string({k.lower()}, ', ') END" for k in P.FILES_MAX) + "], lambda x: x IS NOT NULL), chr(10)) AS files"
MERGE_SQL = f"SELECT session_id, {_by_status}, {', '.join(map(_shown, ('goals', 'commits', 'outstanding', 'preferences', 'current_state')))}, len(brief) AS n_brief FROM ({STEPS_SQL})"
SUMMARY_SQL = summary_sql(STEPS_SQL, "Keep open questions.")
COMPACTION_SQL = f"""
SELECT session_id, CAST(tokens_before AS BIGINT) AS tokens_before, CAST(ceil(length(summary) / 4.0) AS BIGINT) AS tokens_after FROM ({summary_sql(sections_sql(A2))})
JOIN (SELECT session_id, sum(ceil(length(text) / 4.0) + ceil(length(coalesce(result, '')) / 4.0)) AS tokens_before FROM ({A2}) GROUP BY session_id) USING (session_id)
"""


def _two_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    whole = cut(work(spark, sf_dir))
    return Y.build_sections(whole.where("ord < 30"), CWD), Y.build_sections(whole.where("ord >= 30"), CWD)


def sections_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = Y.merge_sections(*_two_steps(spark, sf_dir))
    join = lambda c: F.array_join(c, "\n").alias(c)
    return merged.select("session_id", F.array_join(X.file_lines(F.col("files"), last=True), "\n").alias("files"), *map(join, ("goals", "commits", "outstanding", "preferences", "current_state")), F.size("brief").alias("n_brief"))


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two compactions: the second one finds the sections of the first by the hash of its summary."""
    first, second = _two_steps(spark, sf_dir)
    summaries = Y.format_summary(first)
    stored = first.join(summaries, "session_id").withColumn("summary_hash", F.md5("summary")).drop("summary")
    return Y.format_summary(Y.with_previous(second, stored, summaries), instructions="Keep open questions.")


def compaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = Y.format_summary(Y.build_sections(work(spark, sf_dir), CWD))
    return Y.compaction_report(E.message_tokens(S.tool_messages(spark, sf_dir)), summaries)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries on every session of the tool log, as a user would write them."""
    forms = ["retry loader page:1", "scope:history /error: case [0-9]+/", "mode:file src/m5.ts", "#12", "#3:module", "/NIGHTLY build/i", "mode:regex staging (bucket|bin)", "scope:memory loader", "0123456789ab", "  ", "/foo(/"]
    sessions = S.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id")).distinct()
    rows = sessions.select("session_id", F.posexplode(F.array(*map(F.lit, forms))).alias("n", "raw"))
    return rows.withColumn("query_id", F.concat("session_id", F.lit("/"), F.col("n").cast("string")))


def query_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = F.substring_index("error", ":", 1).alias("error")
    return R.routed(_asked(spark, sf_dir)).select("query_id", "kind", "page", "scope", "term", "entry", "drill", why)


ROUTES_SQL = """
WITH r(n, kind, page, scope, term, entry, drill, error) AS (VALUES (0, 'text', 1, 'all', 'retry loader', NULL, NULL, NULL), (1, 'regex', 1, 'history', '(?i)error: case [0-9]+', NULL, NULL, NULL), (2, 'file', 1, 'all', 'src/m5.ts', NULL, NULL, NULL),
  (3, 'index', 1, 'all', NULL, 12, NULL, NULL), (4, 'index', 1, 'all', NULL, 3, 'module', NULL), (5, 'regex', 1, 'all', '(?i)NIGHTLY build', NULL, NULL, NULL), (6, 'regex', 1, 'all', '(?i)staging (bucket|bin)', NULL, NULL, NULL),
  (7, 'text', 1, 'memory', 'loader', NULL, NULL, NULL), (8, 'id', 1, 'all', '0123456789ab', NULL, NULL, NULL), (9, 'error', 1, 'all', '', NULL, NULL, 'empty query'), (10, 'error', 1, 'all', '(?i)foo(', NULL, NULL, 'bad regex'))
SELECT CAST(user_id AS STRING) || '/' || n AS query_id, kind, page, scope, term, CAST(entry AS BIGINT) AS entry, drill, error FROM (SELECT DISTINCT user_id FROM events), r
"""


def regex_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked page of every pattern on its session and scope, the newest entries first and memory items last; a bad pattern has none."""
    whole = cut(named_work(spark, sf_dir))
    hits = R.regex_hits(R.documents(whole, _remembered(whole)), R.routed(_asked(spark, sf_dir)))
    return R.page_of(hits, [F.desc("doc_ord")], F.col("page")).select("query_id", F.col("doc_ord").alias("index"), "rank", "n_hits")


def regex_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by trigrams that two batches of documents have left: only candidates are matched."""
    whole = cut(named_work(spark, sf_dir))
    docs, folder = R.documents(whole, _remembered(whole)), new_folder(spark, "grams")
    for batch, part in enumerate([docs.where("doc_ord < 30"), docs.where("doc_ord >= 30")]):
        R.keep_grams(part, folder, batch)
    hits = R.regex_hits(docs, R.routed(_asked(spark, sf_dir)), spark.read.parquet(folder))
    return R.page_of(hits, [F.desc("doc_ord")], F.col("page")).select("query_id", F.col("doc_ord").alias("index"), "rank", "n_hits")


REGEX_SQL = f"""
WITH h AS (SELECT session_id || '/1' AS query_id, ord FROM ({A2}) WHERE regexp_matches(coalesce(result, ''), 'error: case [0-9]+')
  UNION ALL SELECT session_id || '/5', unnest([ord, ord - 1099511627776]) FROM ({A2}) WHERE text LIKE '%nightly build%'
  UNION ALL SELECT session_id || '/6', unnest([ord, ord - 1099511627776]) FROM ({A2}) WHERE text LIKE '%staging bucket%'),
r AS (SELECT query_id, ord AS index, row_number() OVER (PARTITION BY query_id ORDER BY ord DESC) AS rank, count(*) OVER (PARTITION BY query_id) AS n_hits FROM h)
SELECT query_id, index, rank, n_hits FROM r WHERE rank <= 8
"""


def file_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.file_hits(named_work(spark, sf_dir), R.routed(_asked(spark, sf_dir)), CWD)
    return R.page_of(hits, [F.desc("index")], F.col("page")).select("query_id", "index", "rank", "n_hits", "lines")


FILE_SQL = f"""
WITH h AS (SELECT session_id || '/2' AS query_id, ord, tool || ': ' || coalesce(command, replace(file_path, '/work/app/', '')) AS lines FROM ({A2}) WHERE coalesce(file_path, command) LIKE '%src/m5.ts%'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord DESC) AS rank, count(*) OVER (PARTITION BY query_id) AS n_hits FROM h)
SELECT query_id, ord AS index, rank, n_hits, lines FROM r WHERE rank <= 8
"""


def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drilled(work(spark, sf_dir), R.routed(_asked(spark, sf_dir))).select("query_id", "index", "line_no", "line")


LINES_SQL = f"""
WITH h AS (SELECT session_id || '/4' AS query_id, ord AS index, string_split(concat_ws(chr(10), nullif(text, ''), tool, CASE WHEN file_path IS NOT NULL THEN 'file_path: ' || file_path END, CASE WHEN command IS NOT NULL THEN 'command: ' || command END, result), chr(10)) AS l FROM ({A2}) WHERE ord = 3),
x AS (SELECT query_id, index, l, unnest(range(1, len(l) + 1)) AS line_no FROM h)
SELECT query_id, index, line_no, l[line_no] AS line FROM x WHERE lower(l[line_no]) LIKE '%module%'
"""


def expanded_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = named_work(spark, sf_dir)
    items = whole.where("role = 'user'").select("session_id", F.col("index").alias("ord"), F.concat(F.lit("i"), F.col("index").cast("string")).alias("id"), F.array("entry_id").alias("sources"), F.lit(False).alias("dropped"))
    return R.expanded(whole, items, R.routed(_asked(spark, sf_dir)), CWD).select("query_id", "entry_id", "text", F.array_join("related", ",").alias("related"))


_entry_ids = f"""
WITH RECURSIVE m AS ({A2}),
k AS (SELECT *, CASE WHEN role = 'assistant' THEN 'a:' || tool_use_id ELSE 'u:' || md5(chr(10) || md5(text)) END AS key FROM m WHERE ord = 0
  UNION ALL SELECT m.*, CASE WHEN m.role = 'assistant' THEN 'a:' || m.tool_use_id ELSE 'u:' || md5(k.key || chr(10) || md5(m.text)) END FROM k JOIN m ON m.session_id = k.session_id AND m.ord = k.ord + 1)
SELECT *, substr(md5(key), 1, 12) AS entry_id FROM k
"""
EXPANDED_SQL = f"""
SELECT session_id || '/3' AS query_id, entry_id, concat_ws(chr(10), '#12 [' || entry_id || '] ' || role, nullif(text, ''), chr(10) || '• ' || tool || ': ' || coalesce(command, replace(file_path, '/work/app/', '')) || CASE WHEN is_error THEN ' (error)' ELSE '' END,
  '  input: ' || CASE WHEN command IS NOT NULL THEN '{{"command":"' || replace(command, '"', '\\"') || '"}}' WHEN file_path IS NOT NULL THEN '{{"file_path":"' || file_path || '"}}' END, result) AS text,
  CASE WHEN role = 'user' THEN 'i12' ELSE '' END AS related FROM ({_entry_ids}) WHERE ord = 12
"""


def _remembered(entries: DataFrame) -> DataFrame:
    """What users said as memory items."""
    return entries.where("role = 'user'").select("session_id", F.col("index").alias("ord"), F.concat(F.lit("i"), F.col("index").cast("string")).alias("id"), F.col("text").alias("content"), F.lit(False).alias("dropped"))


def recall_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked page of every text query on its session and scope, memory items before entries, each with a snippet."""
    whole = cut(named_work(spark, sf_dir))
    docs = cut(R.documents(whole, _remembered(whole)))
    queries = cut(R.routed(_asked(spark, sf_dir)).where("kind = 'text'"))
    keys = ["session_id", "ref", "doc_ord"]
    hits = R.bm25(R.scoped(docs), queries, [*keys, "scope"], ["session_id", "scope"]).join(queries.select("query_id", "page"), "query_id")
    page = R.page_of(hits, [F.desc("score"), F.col("doc_ord")], F.col("page")).drop("page", "scope")
    best = page.join(docs.select("session_id", "ref", "doc_ord", "text"), keys).join(queries.select("query_id", "term"), "query_id")
    return best.select("query_id", "ref", "rank", "score", "n_hits", T.snippet(F.col("text"), R.first_hit(F.col("text"), F.col("term"))).alias("snippet"))


#: Texts are shorter than half a snippet.
RECALL_SQL = f"""
WITH e AS ({_entry_ids}),
x AS (SELECT session_id, 'e:' || entry_id AS ref, CAST(ord AS BIGINT) AS doc_ord, 'history' AS kind, concat_ws(chr(10), nullif(text, ''), tool, CASE WHEN file_path IS NOT NULL THEN 'file_path: ' || file_path END, CASE WHEN command IS NOT NULL THEN 'command: ' || command END, result) AS text FROM e
  UNION ALL SELECT session_id, 'o:i' || ord, CAST(ord AS BIGINT) - 1099511627776, 'memory', text FROM e WHERE role = 'user'),
d AS (SELECT *, {_tokens_sql("text")} AS t, unnest(['all', kind]) AS scope FROM x),
stats AS (SELECT session_id, scope, count(*) AS n, avg(len(t)) AS mean FROM d GROUP BY ALL),
q AS (SELECT DISTINCT session_id, n AS no, scope, term FROM e, (VALUES (0, 'all', 'retry'), (0, 'all', 'loader'), (7, 'memory', 'loader')) AS v(n, scope, term)),
tf AS (SELECT session_id, scope, ref, doc_ord, dl, term, count(*) AS tf FROM (SELECT session_id, scope, ref, doc_ord, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT session_id, scope, term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT session_id, no, ref, doc_ord, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM q JOIN tf USING (session_id, scope, term) JOIN df USING (session_id, scope, term) JOIN stats USING (session_id, scope) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, no ORDER BY score DESC, doc_ord) AS rank, count(*) OVER (PARTITION BY session_id, no) AS n_hits FROM s WHERE score > 0)
SELECT r.session_id || '/' || no AS query_id, ref, rank, score, n_hits, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS snippet FROM r JOIN x USING (session_id, ref) WHERE rank <= 8
"""


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_kept, entries, archive_corpus, new_entries, window_entries, text_scalars, marked_texts, token_report, noise_filtered, tool_one_liners, shell_features, shell_writes, tool_fold, brief_transcript, files_touched, open_errors, outstanding,
    commits, session_goals, preferences, user_reports, last_state, current_state, sections_merge, session_summary, compaction_report, query_routes, regex_hits, regex_indexed, file_hits, entry_lines, expanded_entries, recall_snippet,
)}
ORACLE_SQL = {
    "bm25_topk": BM25_SQL, "bm25_kept": BM25_SQL, "entries": ENTRIES_SQL, "archive_corpus": ARCHIVE_SQL, "new_entries": NEW_SQL, "window_entries": WINDOW_SQL, "text_scalars": SCALARS_SQL, "marked_texts": MARKED_SQL, "shell_writes": WRITES_SQL, "token_report": TOKENS_SQL, "noise_filtered": NOISE_SQL,
    "tool_one_liners": LINERS_SQL, "shell_features": SHELL_SQL, "tool_fold": FOLD_SQL, "files_touched": FILES_SQL, "open_errors": ERRORS_SQL, "outstanding": OUTSTANDING_SQL, "commits": COMMITS_SQL, "session_goals": GOALS_SQL,
    "preferences": PREFERENCES_SQL, "user_reports": REPORTS_SQL, "last_state": STATE_SQL, "query_routes": ROUTES_SQL, "regex_hits": REGEX_SQL, "regex_indexed": REGEX_SQL, "brief_transcript": BRIEF_SQL, "current_state": CURRENT_SQL, "sections_merge": MERGE_SQL, "session_summary": SUMMARY_SQL, "compaction_report": COMPACTION_SQL,
    "expanded_entries": EXPANDED_SQL, "recall_snippet": RECALL_SQL, "file_hits": FILE_SQL, "entry_lines": LINES_SQL,
}

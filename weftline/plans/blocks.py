"""Queries over line parsers. The tables' prose has no numbered or marked lines, so that each query marks lines of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import blocks as B
from weftline.plans.common import Tables, query


def _lines(t: Tables, mark) -> DataFrame:
    """The lines of all documents, each marked by mark(line, number of the line)."""
    rows = t.documents.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rows.select("doc_id", "n", F.trim(F.regexp_replace(mark(F.col("line"), F.col("n")), "[ \\t]+", " ")).alias("line"))


def _faq(line: Column, n: Column) -> Column:
    return F.when(n % 7 == 0, F.concat(F.lit("1. RUBRIQUE NUMERO "), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("2. Que dit "), F.substring(line, 1, 30), F.lit(" ?"))).otherwise(line)


def _guide(line: Column, n: Column) -> Column:
    return F.when(n % 6 == 0, F.concat(F.lit("(Titre) "), F.substring(line, 1, 30))).when(n % 3 == 1, F.concat(F.lit("(Intertitre) "), F.substring(line, 1, 25))).otherwise(line)


def _marked(line: Column, n: Column) -> Column:
    return F.when(n % 9 == 0, F.concat(F.lit("II. "), F.substring(line, 1, 30))).when(n % 3 == 1, F.concat(F.lit("Question : "), F.substring(line, 1, 40))).otherwise(line)


def _sql_lines(mark: str) -> str:
    return f"""l AS (SELECT doc_id, n, trim(regexp_replace({mark}, '[ \\t]+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL))"""


def _sql(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


_CLEAN = "regexp_replace(regexp_replace(coalesce({0}, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_OVER = "OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)"
_MARKED = rf"""WITH {_sql_lines("CASE WHEN n % 9 = 0 THEN 'II. ' || substr(x, 1, 30) WHEN n % 3 = 1 THEN 'Question : ' || substr(x, 1, 40) ELSE x END")},
q AS (SELECT *, regexp_matches(line, '{_sql(B.QUESTION)}') AS q FROM l), k AS (SELECT *, NOT q AND regexp_matches(line, '{_sql(B.MARKED_HEADING)}') AS h FROM q),
t AS (SELECT *, nullif(CASE WHEN h THEN trim(regexp_replace(line, '^[IVXLC]+[.\-]\s+|\d+[.)]\s+', '', 'g')) END, '') AS head FROM k),
p AS (SELECT doc_id, n, concat_ws(' > ', lag(head, 3) OVER w, lag(head, 2) OVER w, lag(head, 1) OVER w, head) AS path FROM t WHERE head IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT t.*, last_value(path IGNORE NULLS) {_OVER} AS path, sum(CAST(q AS INT)) {_OVER} AS block FROM t LEFT JOIN p USING (doc_id, n)),
g AS (SELECT doc_id, block, min(n) AS n, arg_min(line, n) AS title, arg_max_null(path, n) AS parent_path, {_CLEAN.format("string_agg(line, chr(10) ORDER BY n) FILTER (NOT q AND NOT h)")} AS answer FROM r WHERE block > 0 GROUP BY doc_id, block),
i AS (SELECT *, sha1(lower(trim(regexp_replace(title, '\s+', ' ', 'g')))) AS qa_id, NOT regexp_matches(title, '{_sql(B.SUB_QUESTION)}') OR row_number() OVER (PARTITION BY doc_id, parent_path ORDER BY n) = 1 AS root FROM g),
j AS (SELECT *, CASE WHEN NOT root THEN last_value(CASE WHEN root THEN qa_id END IGNORE NULLS) OVER (PARTITION BY doc_id, parent_path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_qa_id FROM i),
blocks AS (SELECT doc_id, CAST(block AS INT) AS section_index, 3 AS level, title, parent_path, concat_ws(' > ', parent_path, title) AS path, CASE WHEN ends_with(title, '?') THEN title ELSE title || '?' END AS question, answer, qa_id, parent_qa_id FROM j WHERE answer <> '')"""
_FAQ = rf"""WITH {_sql_lines("CASE WHEN n % 7 = 0 THEN '1. RUBRIQUE NUMERO ' || n WHEN n % 3 = 1 THEN '2. Que dit ' || substr(x, 1, 30) || ' ?' ELSE x END")},
a AS (SELECT *, regexp_matches(line, '^\d{{1,2}}\s*\.\s*(.+)$') AS num, regexp_matches(line, '\.{{5,}}\s*\d+\s*$') OR (regexp_matches(line, '^\d{{1,2}}\s*\.\s*(.+)$') AND regexp_matches(line, '\?\s+\d{{1,3}}$')) AS entry FROM l),
b AS (SELECT *, line = '' OR regexp_matches(line, '^\d{{1,3}}$') OR entry AS dropped FROM a),
c AS (SELECT *, sum(CAST((num AND NOT dropped) OR line = '' OR entry AS INT)) {_OVER} AS seg FROM b),
d AS (SELECT *, trim(regexp_extract(line, '^\d{{1,2}}\s*\.\s*(.+)$', 1), ' -:' || chr(9)) AS title FROM c WHERE NOT dropped),
e AS (SELECT *, length(regexp_replace(title, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(title, '[^\p{{Lu}}]', '', 'g')) AS caps FROM d),
f AS (SELECT *, num AND letters > 0 AND caps >= 0.65 * letters AND len(list_filter(string_split(title, ' '), lambda w: w <> '')) >= 2 AS sec FROM e),
h AS (SELECT *, bool_or(num) OVER s AS headed, bool_or(sec) OVER s AS as_section, min(n) FILTER (contains(line, '?')) OVER s AS ends FROM f WINDOW s AS (PARTITION BY doc_id, seg)),
i AS (SELECT *, headed AND (as_section OR ends IS NULL OR n <= ends) AS joined FROM h),
m AS (SELECT doc_id, min(n) FILTER (num) AS n, as_section, {_CLEAN.format("string_agg(line, ' ' ORDER BY n)")} AS line FROM i WHERE joined GROUP BY doc_id, seg, as_section),
o AS (SELECT doc_id, n, line, as_section, trim(regexp_extract(line, '^\d{{1,2}}\s*\.\s*(.+)$', 1), ' -:' || chr(9)) AS title FROM m),
k AS (SELECT doc_id, n, line, title, CASE WHEN as_section THEN 'section' WHEN contains(title, '?') AND len(list_filter(string_split(title, ' '), lambda w: w <> '')) >= 3 THEN 'question' ELSE 'body' END AS kind FROM o UNION ALL SELECT doc_id, n, line, NULL, 'body' FROM i WHERE NOT joined),
p AS (SELECT *, sum(CAST(kind <> 'body' AS INT)) {_OVER} AS part, sum(CAST(kind = 'question' AS INT)) {_OVER} AS idx, last_value(CASE WHEN kind = 'section' THEN title END IGNORE NULLS) {_OVER} AS section FROM k),
z AS (SELECT doc_id, part, {_CLEAN.format("string_agg(line, chr(10) ORDER BY n)")} AS answer FROM p WHERE kind = 'body' AND part > 0 GROUP BY doc_id, part)
SELECT p.doc_id, CAST(idx AS INT) AS section_index, 3 AS level, title, section AS parent_path, concat_ws(' > ', section, title) AS path, CASE WHEN ends_with(title, '?') THEN title ELSE title || '?' END AS question, answer, sha1('faq|' || p.doc_id || '|' || idx || '|' || coalesce(section, 'None') || '|' || title) AS qa_id, CAST(NULL AS VARCHAR) AS parent_qa_id
FROM p JOIN z ON z.doc_id = p.doc_id AND z.part = p.part WHERE kind = 'question' AND answer <> ''"""


@query(_FAQ)
def faq_blocks(t: Tables) -> DataFrame:
    return B.faq_blocks(_lines(t, _faq))


@query()
def guide_blocks(t: Tables) -> DataFrame:
    return B.guide_blocks(_lines(t, _guide))


@query(f"{_MARKED} SELECT * FROM blocks")
def marked_blocks(t: Tables) -> DataFrame:
    return B.marked_blocks(_lines(t, _marked))


@query(f"""{_MARKED}, c AS (SELECT doc_id, section_index, qa_id, 'Q_ONLY' AS role, 0 AS position, question AS chunk FROM blocks UNION ALL SELECT doc_id, section_index, qa_id, 'QA_COMPOSITE', 1, substr('Q: ' || question || chr(10) || 'R: ' || answer, 1, 1500) FROM blocks
UNION ALL SELECT doc_id, section_index, qa_id, 'A_ATOMIC', CAST(2 + i // 1000 AS INT), substr(answer, i + 1, 1200) FROM (SELECT *, unnest(range(0, length(answer), 1000)) AS i FROM blocks WHERE length(answer) > 1200)) SELECT doc_id, qa_id, role, position, chunk, min(section_index) AS section_index FROM c GROUP BY doc_id, qa_id, role, position, chunk""")
def block_chunks(t: Tables) -> DataFrame:
    return B.block_chunks(B.marked_blocks(_lines(t, _marked)), "qr", composite=1500)


@query()
def process_blocks(t: Tables) -> DataFrame:
    return B.process_blocks(_lines(t, lambda line, n: F.when(n % 5 == 0, F.concat(F.lit("publication de "), F.substring(line, 1, 40))).when(n % 5 == 1, "si hors rdr").otherwise(line)))


@query()
def matrix_blocks(t: Tables) -> DataFrame:
    return B.matrix_blocks(_lines(t, lambda line, n: F.when(n % 4 == 0, F.concat(F.substring(line, 1, 40), F.lit(" 3° CBCM"))).when(n % 9 == 1, "Disciplinaire").when(n % 4 == 3, "DRH-BPECO").otherwise(line)))


@query()
def routed_blocks(t: Tables) -> DataFrame:
    return B.route(t.documents.filter("text is not null").groupBy("doc_id").agg(F.min("text").alias("text")))

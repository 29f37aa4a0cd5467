"""Relations derived from the test tables, in Spark and in SQL for DuckDB: structured Markdown and synthetic OCR words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MD = """
SELECT doc_id, {agg} AS md FROM (
  SELECT doc_id, i, concat(CASE WHEN i % 5 = 0 THEN concat('<!-- page ', CAST({i5} AS {s}), ' -->', chr(10), chr(10)) ELSE '' END,
    CASE WHEN i % 14 = 1 THEN concat('# ', line) WHEN i % 7 = 1 THEN concat('## ', line)
         WHEN i % 7 = 3 THEN concat('| k | v |', chr(10), '|---|---|', chr(10), '| n | ', CAST(n_chars AS {s}), ' |')
         WHEN i % 7 = 5 THEN concat('![fig](images/fig_', CAST(i AS {s}), '.png)')
         WHEN i % 7 = 6 THEN concat('cost $x_', CAST(i AS {s}), '$ and $$y$$ end') ELSE line END) AS b
  FROM ({lines}) l) m GROUP BY doc_id"""

MD_DUCK = _MD.format(s="VARCHAR", i5="i // 5", agg="string_agg(b, chr(10) || chr(10) ORDER BY i)", lines="SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents")
MD_SPARK = _MD.format(s="STRING", i5="i div 5", agg="listagg(b, chr(10) || chr(10)) WITHIN GROUP (ORDER BY i)", lines="SELECT doc_id, n_chars, i, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) p AS i, line")

_CONF = "CASE WHEN (doc_id + 3 * line + 5 * word) % 41 = 0 THEN -1.0 ELSE CAST((31 * doc_id + 17 * line + 7 * word + 13 * length(text)) % 1010 AS DOUBLE) / 10.0 END"
_WORDS = f"""
SELECT *, {_CONF} AS conf,
  100000 * line + word AS ord, {{div}} % 4 AS block, 1 - line % 2 AS par, 70 * word + (7 * doc_id + 3 * word) % 9 AS x, 30 * line + (5 * word + doc_id) % 4 AS y, 8 * length(text) AS width, 18 AS height
FROM ({{words}}) w WHERE text <> ''"""
WORDS_DUCK = _WORDS.format(div="(line // 3)", words="SELECT doc_id, line, unnest(string_split(l, ' ')) AS text, generate_subscripts(string_split(l, ' '), 1) - 1 AS word FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) a")
WORDS_SPARK = _WORDS.format(div="(line div 3)", words="SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(word AS BIGINT) AS word, text FROM (SELECT doc_id, line, l FROM documents LATERAL VIEW posexplode(split(text, '\\n')) p AS line, l) a LATERAL VIEW posexplode(split(l, ' ')) q AS word, text")

LINES_SPARK = f"""
SELECT doc_id, s.line, s.words FROM (SELECT doc_id, explode(transform(split(text, '\\n'), (l, i) -> transform(array(CAST(i AS BIGINT)), line -> named_struct('line', line, 'words',
  filter(transform(split(l, ' '), (text, word) -> named_struct('word', CAST(word AS BIGINT), 'text', text, 'conf', {_CONF})), w -> w.text <> '')))[0])) AS s FROM {{documents}}) a"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MD_SPARK.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic words: their geometry and confidence are computed, not recognised."""
    return spark.sql(WORDS_SPARK.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def ocr_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line, words: word, text, conf in order): what ocr_words holds, by the lines of each row of documents."""
    return documents.sparkSession.sql(LINES_SPARK, documents=documents)

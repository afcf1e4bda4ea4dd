"""Drop lines that repeat across documents, keeping them where the largest document id holds them.

Plan: every text gives its distinct line keys as 128-bit hashes (one pass of Python over Arrow bytes); distinct
(hash, document) pairs are counted per hash, with partial aggregation before each exchange, so a line that a
third of all documents share travels as one row per task. Hashes over the threshold are joined back to
those pairs: the ``HOT`` most frequent ones by broadcast (their number is fixed), all others, none of which
then holds more than one in ``HOT`` of the pairs, by an exchange. What remains per document is the list of
hashes to drop, which meets the texts in one join on the document id; a last pass reassembles the kept
lines by position.

Defined results: a null or empty text is one empty line. Rows that share a document id count as one
document and are treated alike. A row with a null id is a document of its own below all others (rows of equal text are one).
An empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, small_batches, table, utf8

#: Hashes joined by broadcast; 256 rows of 40 bytes.
HOT = 256
WHITE = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(WHITE).lower()  # of bytes: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8")) < min_chars:
        return None
    return key


def _key_of_row(doc_id: Column, text: Column) -> Column:
    """The id, or one made of the text in a range that ids don't use: null ids mustn't meet in one group."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)) + F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)))


def _digest():
    import xxhash

    return xxhash.xxh3_128_digest


def line_hashes(texts: DataFrame, min_chars: int) -> DataFrame:
    """key binary(16), id: each distinct key of each row of ``texts`` (id, text)."""

    def task(batches):
        digest = _digest()
        for batch in sliced(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                own = {key_of(line, min_chars) for line in text.split(b"\n")}
                own.discard(None)
                keys += map(digest, own)
                ids += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "id"])

    return small_batches(texts.select("id", "text")).mapInArrow(task, "key binary, id long")


def drops(texts: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """id, keys array<binary>: the hashes whose lines the document loses."""
    pairs = table(line_hashes(texts, min_chars).distinct(), "line-pairs")
    counted = pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    counted = table(counted, "line-counts")
    hot = F.broadcast(counted.orderBy(F.desc("n"), "key").limit(HOT))
    by_hot = pairs.join(hot, "key").where("id < keeper").select("id", "key")
    rest = pairs.join(F.broadcast(hot.select("key")), "key", "left_anti")
    by_rest = rest.join(counted, "key").where("id < keeper").select("id", "key")
    return by_hot.unionByName(by_rest).groupBy("id").agg(F.collect_list("key").alias("keys"))


def dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text as struct ``row``, with ``kept`` text, ``n_lines`` and ``n_dropped``."""
    packed = docs.select(
        _key_of_row(docs[id_col], docs[text_col]).alias("id"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")
    )
    return _reassemble(packed, drops(packed.select("id", "text"), min_chars, min_docs), min_chars)


def _reassemble(packed: DataFrame, dropped: DataFrame, min_chars: int) -> DataFrame:
    kind = pa.schema([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def task(batches):
        digest = _digest()
        for batch in sliced(batches):
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(utf8(batch.column("text")), batch.column("keys").to_pylist()):
                lines = text.split(b"\n")
                stay = lines
                if gone:
                    gone = set(gone)
                    stay = [x for x in lines if (key := key_of(x, min_chars)) is None or digest(key) not in gone]
                kept.append(b"\n".join(stay).decode("utf-8"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((kept, n_lines, n_dropped), kind)], schema=kind)
            rest = [(n, batch.column(n)) for n in batch.schema.names if n not in ("text", "keys")]
            yield pa.RecordBatch.from_arrays([*found.columns, *(c for _, c in rest)], [*kind.names, *(n for n, _ in rest)])

    joined = packed.join(dropped.hint("shuffle_hash"), "id", "left")  # the texts needn't be sorted for it
    carried = [f for f in joined.schema.fields if f.name not in ("text", "keys")]
    schema = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), *carried])
    return small_batches(joined.select("text", "keys", *[f.name for f in carried])).mapInArrow(task, schema)


def digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    slim = docs.select(docs["doc_id"], docs["text"])
    packed = slim.select(_key_of_row(F.col("doc_id"), F.col("text")).alias("id"), "text", "doc_id")
    done = _reassemble(packed, drops(packed.select("id", "text"), min_chars, min_docs), min_chars)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def stage(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with its texts deduplicated by line, ``n_chars`` brought up to date. A document that loses all lines goes."""
    done = dedup(docs, min_chars, min_docs).where("n_lines > n_dropped")
    columns = [F.col("kept").alias(c) if c == "text" else F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*columns)


#: DuckDB: the same from the texts alone.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), counted AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (c.key IS NOT NULL AND k.doc_id <> c.keeper) AS gone
  FROM keyed k LEFT JOIN counted c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

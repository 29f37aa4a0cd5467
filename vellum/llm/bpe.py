"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts become runs of word numbers; words not met before in a task go to the JVM as byte arrays.
There a fold merges, round by round, the adjacent pair of lowest rank, looked up in arrays of ranks
beside every row, until no pair has a rank, and each word's ids are decoded by concatenating binary pieces. Python
around it only splits texts into words, once, and strings the words' ids and bytes together. Nothing
is shuffled. A task holds at most `CACHE_BYTES` of words; then it numbers them anew.

Null and empty texts have no tokens; repeated rows are encoded each; rows without a key are kept;
other columns are not read; empty tables give no rows. A word of up to `LONG_WORD` bytes merges one
place a round; a longer one all places of a pair at once, so its time grows with its length times
the number of different merges in it, not with the square of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import bpe_tables, rows, segments
from vellum.llm.mapping import give_back
from vellum.llm.wordnumbers import Numbers

#: Words longer than this merge all places of a pair at once instead of the leftmost.
LONG_WORD = 64
#: What a task may keep of words; folding them again takes longer than counting them does.
CACHE_BYTES = 96 << 20
#: Documents travel to the JVM in bundles of about so many characters, with their new words.
BUNDLE_CHARS = 1 << 20
BUNDLE = "keys array<bigint>, numbers array<binary>, reset boolean, words array<array<int>>"
#: A run of these behind letters is one pre-token. The apostrophe is not among them, as letters can follow it in one.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: No symbol: beyond either end of a word; and the owner of empty slots. Ids are below both.
NOTHING, UNOWNED = 0xFFFF, 0xFFFE
#: A byte's neighbour is a byte or, at the end, 256.
NEXT = 257


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), f"array<{kind}>")


def _numbers(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte and the next -> their rank and the first's id, as a symbol; id -> displacement; slot -> left id * 2^16 + rank."""
    _, byte_ids, (d, owner, ranks) = bpe_tables.from_ranks(path)
    assert len(d) <= UNOWNED
    wide = np.zeros(NOTHING + 1, np.int64)
    wide[: len(d)] = d
    packed = np.full(len(owner) + NOTHING + 1, UNOWNED << 16, np.int64)
    taken = owner >= 0
    packed[: len(owner)][taken] = (owner[taken].astype(np.int64) << 16) | ranks[taken]
    ids = np.append(byte_ids, NOTHING).astype(np.int64)
    ranks_of = packed[wide[ids[:256, None]] + ids[None, :]] ^ (ids[:256, None] << 16)
    symbols = (ranks_of << 31) | ids[:256, None]
    return symbols.ravel(), wide.astype(np.int32), packed


def rank_map(path: str) -> tuple[Column, Column, Column]:
    """What `_numbers` gives, as literals."""
    symbols, wide, packed = (x.tolist() for x in _numbers(path))
    return _literal(symbols, "bigint"), _literal(wide, "int"), _literal(packed, "bigint")


def with_ranks(df: DataFrame, path: str) -> tuple[DataFrame, list[str]]:
    """(df with what `_numbers` gives in every row, its columns' names).

    Arrays of a row hold plain numbers side by side; those of a literal are an object a number, which takes far longer to look up.
    """
    names = [rows.fresh(df, n) for n in ("symbols", "displacements", "ranks")]
    one = pa.table({n: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for n, x in zip(names, _numbers(path), strict=True)})
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame(one))), names


def pairs(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(each byte of all words with the next one as byte * NEXT + next, the last with 256; ends of the words, from 0)."""
    ends = np.cumsum([0, *map(len, raw)])
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
    after = np.append(flat[1:], 256)
    after[ends[1:] - 1] = 256
    return (flat * NEXT + after).astype(np.int32), ends.astype(np.int32)


def pieces(path: str) -> Column:
    """Literal: id -> its bytes, as hexadecimal digits."""
    return _literal([f'"{t.hex()}"' for t in bpe_tables.token_bytes(path)], "string")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rank(a: Column, b: Column, tables: tuple[Column, Column, Column]) -> Column:
    """The rank of a pair of ids, or a number above all ranks: the slot's owner cancels out only if it is a."""
    _, disp, packed = tables
    return F.get(packed, F.get(disp, a.cast("int")) + b.cast("int")).bitwiseXOR(F.shiftleft(a.cast("bigint"), 16))


def _leftmost(word: Column, tables: tuple[Column, Column, Column]) -> Column:
    """Merges one place a round.

    A symbol is one number: 32 bits for its rank with its right neighbour, 15 for the place of its first byte, 16 for
    its id. So the least number is the leftmost pair of lowest rank.
    """
    none, low = F.lit(1 << 47), F.lit((1 << 31) - 1)  # a rank of 2^16; place and id
    own = lambda x: F.coalesce(x.bitwiseAND(F.lit(NOTHING)), F.lit(NOTHING))

    def step(s: Column, _: Column) -> Column:
        def merged(m: Column) -> Column:
            new = F.shiftright(m, 31)

            def put(at: Column) -> Column:  # the pair is the symbols at - 1 and at, counted from 0
                before, after = F.get(s, at - 2), F.get(s, at + 1)
                left = F.shiftleft(_rank(own(before), new, tables), 31).bitwiseOR(before.bitwiseAND(low))
                joined = F.shiftleft(_rank(new, own(after), tables), 31).bitwiseOR(m.bitwiseAND(F.lit(0x7FFF << 16))).bitwiseOR(new)
                placed = F.transform(s, lambda x, i: F.when(i > at, x).when(i < at - 2, x).when(i == at - 1, joined).when(i == at, F.lit(-1).cast("bigint")).otherwise(left))
                return F.array_remove(placed, F.lit(-1).cast("bigint"))

            return F.when(m >= none, s).otherwise(_let(F.array_position(s, m).cast("int"), put))

        return _let(F.array_min(s), merged)

    start = F.transform(word, lambda pair, i: F.get(tables[0], pair) + F.shiftleft(i.cast("bigint"), 16))
    return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(word), F.lit(2))), start, step, lambda s: F.transform(s, lambda x: own(x).cast("int")))


def _everywhere(word: Column, tables: tuple[Column, Column, Column]) -> Column:
    """Merges all places of the pair of lowest rank each round; of overlapping places the first, third, ... count."""
    none = F.lit(1 << 16)

    def ranks_of(ids: Column) -> Column:
        return F.transform(ids, lambda a, i: _rank(a, F.coalesce(F.get(ids, i + 1), F.lit(NOTHING)), tables))

    def state(ids: Column) -> Column:
        return _let(ranks_of(ids), lambda r: F.struct(ids.alias("ids"), r.alias("ranks"), F.coalesce(F.array_min(r), none).alias("low")))

    def step(s: Column, _: Column) -> Column:
        ids, m = s["ids"], s["low"]
        marks = F.split(F.regexp_replace(F.array_join(F.transform(s["ranks"], lambda r: F.when(r == m, F.lit("1")).otherwise(F.lit("0"))), ""), "11", "1x"), "")
        kept = _let(
            marks,
            lambda k: F.filter(
                F.transform(ids, lambda x, i: F.when(F.get(k, i) == "1", m.cast("int")).when((i > 0) & (F.get(k, i - 1) == "1"), F.lit(-1)).otherwise(x)),
                lambda x: x >= 0,
            ),
        )
        return F.when(m >= none, s).otherwise(_let(kept, state))

    start = _let(F.transform(word, lambda pair: F.get(tables[0], pair).bitwiseAND(F.lit(NOTHING)).cast("int")), state)
    return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(word), F.lit(2))), start, step, lambda s: s["ids"])


def encode_bytes(word: Column, tables: tuple[Column, Column, Column]) -> Column:
    """The ids (array<int>) of a word's bytes, each with the next one as in `pairs` (array<int>)."""
    return F.when(F.size(word) > LONG_WORD, _everywhere(word, tables)).otherwise(_leftmost(word, tables))


def decode(ids: Column, spelled: Column) -> Column:
    """The bytes (binary) of an array of ids, by the literal `pieces`; time grows with their number."""
    return F.unhex(F.array_join(F.transform(ids, lambda x: F.get(spelled, x)), ""))


def encode_all(words: Column, tables: tuple[Column, Column, Column]) -> Column:
    """The ids of each word of an array; the literals are bound once, as lambda variables."""
    byte_ids, disp, packed = tables
    return _let(byte_ids, lambda b: _let(disp, lambda d: _let(packed, lambda p: F.transform(words, lambda w: encode_bytes(w, (b, d, p))))))


def decode_all(ids: Column, spelled: Column) -> Column:
    """The bytes of each of an array of arrays of ids."""
    return _let(spelled, lambda s: F.transform(ids, lambda x: decode(x, s)))


def _bundles(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        known = Numbers(find, MARKS)
        keys: list = []
        numbers: list[bytes] = []
        n, reset = 0, True

        def flush():
            flat, ends = pairs([w.encode("utf-8") for w in known.new()])
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            words = one(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            return pa.RecordBatch.from_arrays([one(pa.array(keys, pa.int64())), one(pa.array(numbers, pa.binary())), pa.array([reset]), words], ["keys", "numbers", "reset", "words"])

        for batch in batches:
            texts = batch.column(1)
            for i, key in enumerate(batch.column(0).to_pylist()):
                text = texts[i].as_py() or ""
                keys.append(key)
                numbers.append(known.of(text))
                n += len(text)
                if n >= BUNDLE_CHARS:
                    yield flush()
                    keys, numbers, n, reset = [], [], 0, False
                    if known.bytes > CACHE_BYTES:
                        known, reset = Numbers(find, MARKS), True
        if keys:
            yield flush()
        known = keys = numbers = batch = texts = None
        give_back()

    return run


def _sliced(items: pa.Array) -> list[bytes]:
    """The elements of an array of binaries without nulls."""
    offsets = np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1].tolist()
    data = memoryview(items.buffers()[2]) if len(items) else b""
    return [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]


def _packed(ids: pa.ListArray) -> list[bytes]:
    """Each array of ids as little-endian unsigned 32-bit integers."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    at = (4 * np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])).tolist()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids_of: list[bytes] = []
    bytes_of: list[bytes] = []
    for batch in batches:
        for i in range(batch.num_rows):
            keys, numbers, reset, ids, spelled = (batch.column(k)[i] for k in range(5))
            if reset.as_py():
                ids_of, bytes_of = [], []
            if (ids := ids.values) is not None and len(ids):
                ids_of += _packed(ids)
                bytes_of += _sliced(spelled.values)
            out_ids, out_bytes = [], []
            for of in numbers.as_py():
                own = np.frombuffer(of, "<u4").tolist()
                out_ids.append(b"".join(map(ids_of.__getitem__, own)))
                out_bytes.append(b"".join(map(bytes_of.__getitem__, own)))
            n = pa.array([len(x) // 4 for x in out_ids], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys.as_py(), pa.int64()), n, pa.array(out_ids, pa.binary()), pa.array(out_bytes, pa.binary())], ["key", "n_tokens", "ids", "decoded"])
    ids_of = bytes_of = out_ids = out_bytes = batch = ids = spelled = None
    give_back()


def encode(docs: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """key, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary) of each row."""
    bundles = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(_bundles(pattern), BUNDLE)
    ranked, tables = with_ranks(bundles, ranks_path)
    coded = ranked.withColumn("ids", encode_all(F.col("words"), tuple(map(F.col, tables)))).drop("words", *tables)
    spelled = coded.withColumn("spelled", decode_all(F.col("ids"), pieces(ranks_path)))
    return spelled.mapInArrow(_assemble, "key bigint, n_tokens bigint, ids binary, decoded binary")


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, "doc_id", "text", ranks_path, pattern).select(
        F.col("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

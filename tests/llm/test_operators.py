"""The training-data operators against libraries, brute force and round trips, with odd inputs."""

import bisect
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest

from vellum.llm import ann, bagminhash, bpe, bpe_tables, chat, minhash, packing, pii, rows, segments, substring, token_count, topk, toxicity, words

DATA = "/root/testdata/sf0.001"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = ["", "a", "  two  spaces\n\n\nlines \t tab", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 300 + " y", "é漢字 𝄞 <|endoftext|> z", "it's we'll 12345 a1b2!!!  wide\x1cfs\x85nel", " lead", "trail \n", "nul\0 here", "<|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", "x") for i, t in enumerate([*ODD, None, ODD[2], ODD[2]])] + [(2, ODD[2], "x", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(JSON)
    got = token_count.count_tokens(odd, "doc_id", "text", JSON).collect()
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        assert r.n_tokens == len(tk.encode(text[r.doc_id], add_special_tokens=False).ids), text[r.doc_id]
        assert r.n_bytes == len(text[r.doc_id].encode())
    assert token_count.count_tokens(empty(spark), "doc_id", "text", JSON).count() == 0


def test_bpe_round_trip(spark, odd):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_tables.load_ranks(RANKS), special_tokens={})
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    got = bpe.digest(odd, RANKS, P.PATTERN).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = np.array(enc.encode_ordinary(text[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()), text[r.doc_id][:30]
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert bpe.digest(empty(spark), RANKS, P.PATTERN).count() == 0


def test_letters_and_marks_behind_them_are_split_without_the_pattern():
    import sys

    import public_tokenizers
    import regex

    from vellum.llm import bpe, segments
    from vellum.llm.wordnumbers import Numbers

    letters = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha())
    assert regex.fullmatch(r"\p{L}+", letters) and regex.fullmatch(r"[^\s\p{L}\p{N}]+", bpe.MARKS)
    find = regex.compile(public_tokenizers.PATTERN).findall
    asked = []
    numbers = Numbers(lambda s: asked.append(s) or find(s), bpe.MARKS)
    plain = "ein Wört, größer. das_ 语言!! слово) a. A? ok$$$ word"
    odd = plain + " don't 'sa' x's. .a ., 'll 12. a1, é\u0301. \nx, a\n. b-c d_e, ' '' \u00a0z. ,"
    for text, of in ((plain, plain.split(" ")), (odd, None)):
        asked.clear()
        words: dict[int, str] = {}
        ids = np.frombuffer(numbers.of(text), "<u4").tolist()
        assert segments.split(text) is None or "".join(segments.split(text)) == text
        known = getattr(numbers, "all", []) + numbers.new()
        numbers.all = known
        words = dict(enumerate(known))
        assert [words[i] for i in ids] == find(text)
        if of:
            assert asked == []


def test_bpe_of_long_words_and_decoding(spark):
    import tiktoken
    from pyspark.sql import functions as F

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_tables.load_ranks(RANKS), special_tokens={})
    rng = np.random.default_rng(3)
    texts = ["a" * 100_000, "ab" * 50_000, "".join(rng.choice([*"etaoinshrdlu"], 2000)), "漢字" * 300, "x" * 64, "x" * 65, "é" * 33, "word " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.key: r for r in bpe.encode(df, "doc_id", "text", RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids == np.array(ids, "<u4").tobytes() and got[i].decoded == t.encode()
    ids = spark.createDataFrame([(enc.encode_ordinary("é decoded, by pieces"),), ([],)], "ids array<int>")
    assert [bytes(r[0]).decode() for r in ids.select(bpe.decode(F.col("ids"), bpe.pieces(RANKS))).collect()] == ["é decoded, by pieces", ""]


def test_segments_join_to_the_text():
    for t in ODD:
        parts = segments.split(t)
        assert parts is None or "".join(parts) == t


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(JSON)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = packing.pack(docs, JSON).toPandas()
    by = {k: g.sort_values("piece") for k, g in got.groupby("doc_id")}
    for r in docs.collect():
        ids = np.array([*tk.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        g = by[r.doc_id]
        assert g.length.sum() == len(ids) and (g.length.iloc[1:] == 1024).all()
        for x in g.itertuples():
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all()
    assert s.groupby("sequence_id").length.sum().max() <= 1024
    assert s.sequence_id.nunique() <= -(-s.length.sum() // 1024) + 2
    assert len(packing.pack(odd, JSON).collect()) >= odd.count()
    assert packing.pack(empty(spark), JSON).count() == 0


def test_words_met_end_with_their_task():
    import gc
    import weakref

    gc.disable()
    try:
        encode = packing.encoding(JSON)
        assert list(encode(["two words", "<|endoftext|> x"]))
        words_met = [weakref.ref(c.cell_contents) for c in encode.__closure__ if isinstance(c.cell_contents, token_count.Words)]
        assert words_met
        del encode
        assert [w() for w in words_met] == [None]
    finally:
        gc.enable()


def test_packing_takes_texts_in_slices(spark, monkeypatch):
    sizes, slices = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    pieces = packing._pieces

    def watched(*args):
        run = pieces(*args)

        def each(batches):
            for b in batches:
                sizes.add(int(b["text"].fillna("").str.len().sum()))
                slices.add(1)
                yield b

        return lambda batches: run(each(batches))

    monkeypatch.setattr(packing, "_pieces", watched)
    text = "word " * 60_000
    docs = spark.createDataFrame([((1 << 60) + i if i % 3 else None, text) for i in range(12)], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, JSON).toPandas()
    assert sizes.value == 12 * len(text) and slices.value >= 3
    # beside a null, no id is rounded
    assert {r["doc_id"] for r in packing.pack(docs, JSON).collect()} == {None, *((1 << 60) + i for i in range(12) if i % 3)}
    assert (got.ids_crc32[got.length == 1024].value_counts() > 1).any()


def test_configurations_use_each_piece_once():
    rng = np.random.default_rng(2)
    hist = Counter(rng.integers(1, 1025, 20000).tolist())
    confs = packing.configurations(hist, 1024)
    used = Counter()
    for c, t in confs:
        assert sum(k * v for k, v in c.items()) <= 1024
        for k, v in c.items():
            used[k] += v * t
    assert used == hist
    assert sum(t for _, t in confs) <= best_fit(hist, 1024)


def best_fit(hist, capacity):
    """Sequences of best-fit decreasing, a piece at a time."""
    rooms = []
    for n in sorted(Counter(hist).elements(), reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


def optimum(pieces, capacity):
    """The fewest sequences, by trying all ways to add a piece to an open sequence or a new one."""
    least = len(pieces)

    def place(i, rooms):
        nonlocal least
        if len(rooms) >= least:
            return
        if i == len(pieces):
            least = len(rooms)
            return
        for room in set(rooms):
            if room >= pieces[i]:
                rest = [*rooms]
                rest.remove(room)
                place(i + 1, [*rest, room - pieces[i]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return least


def test_configurations_of_few_pieces_are_optimal():
    rng = np.random.default_rng(8)
    found = []
    for _ in range(40):
        pieces = sorted(rng.integers(5, 70, 10).tolist(), reverse=True)
        confs = packing.configurations(Counter(pieces), 100)
        assert sum((Counter({k: v * t for k, v in c.items()}) for c, t in confs), Counter()) == Counter(pieces)
        found.append(sum(t for _, t in confs) - optimum(pieces, 100))
    assert max(found) <= 1 and sum(found) <= 2
    assert packing.configurations({}, 100) == [] and packing.configurations({100: 3}, 100) == [({100: 1}, 3)]


def test_prices_bound_every_packing():
    rng = np.random.default_rng(9)
    for low, high in ((1, 1024), (200, 520), (300, 1000), (1, 60)):
        hist = Counter(rng.integers(low, high, 3000).tolist())
        lengths = np.array(sorted(hist))
        price, bound = packing.prices(lengths, np.array([hist[n] for n in lengths], float), 1024)
        n = sum(t for _, t in packing.configurations(hist, 1024))
        assert bound <= n <= best_fit(hist, 1024)
        assert bound >= 0.999 * sum(k * v for k, v in hist.items()) / 1024


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 30, 200), rng.integers(0, 30, 300)
    h = lambda x: words.mixed(x.astype(np.uint64) + np.uint64(99))
    s = bagminhash.signatures(np.concatenate([h(a), h(b)]), np.array([200, 300]), 4096)
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    want = sum((ca & cb).values()) / sum((ca | cb).values())
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def brute_classes(rows, threshold=0.8):
    bags = {}
    for i, t in rows:
        w = (t or "").split()
        bags[i] = Counter(zip(*[w[j:] for j in range(5)], strict=False)) if len(w) >= 5 else Counter([tuple(w)]) if w else Counter()
    up = {i: i for i in bags}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if both and both >= threshold * sum((bags[a] | bags[b]).values()):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    rows = {r.doc_id: r.class_id for r in minhash.classes(odd).collect()}
    assert rows[11] == 11 and rows[0] == 0 and rows[12] == rows[13] == rows[2] == 2
    assert minhash.classes(empty(spark)).count() == 0
    assert minhash.keep_first(odd).columns == odd.columns


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows_ = [(1, a), (2, b), (2, a), (3, c), (3, c), (None, a), (4, "\t\n"), (5, "\n\n\t"), (4, "\t\n"), (6, None)]
    df = spark.createDataFrame([(*r, "k", "k", "k") for r in rows_], "doc_id long, text string, _first string, row_key string, gone string")
    kept = sorted(((r.doc_id, r.text) for r in minhash.keep_first(df).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (3, c), (None, a), (4, "\t\n"), (5, "\n\n\t"), (4, "\t\n"), (6, None)], key=str)
    assert minhash.keep_first(df).columns == df.columns
    got = Counter((r.doc_id, r.class_id) for r in minhash.classes(df).collect())
    assert got == Counter([(1, 1), (2, 2), (2, 1), (3, 3), (3, 3), (None, None), (4, 4), (5, 5), (4, 4), (6, 6)])
    marked, key, mended = rows.keyed(df)
    assert mended and key != "row_key" and marked.where(f"doc_id = 2 AND {key} > 2").count() == 2


def test_passages_of_rows_that_share_an_id(spark):
    words_of = lambda x, n: [f"{x}{i}" for i in range(n)]
    shared, own = words_of("s", 80), " ".join(words_of("o", 200))
    first, second = " ".join(words_of("p", 30) + shared), " ".join(words_of("q", 30) + shared + words_of("r", 30))
    df = spark.createDataFrame([(1, first, "k", "k"), (2, second, "k", "k"), (2, own, "k", "k"), (2, second, "k", "k"), (None, second, "k", "k"), (7, None, "k", "k")], "doc_id long, text string, _id string, _spans string")
    out = substring.cut(df)
    left = " ".join(words_of("q", 30) + words_of("r", 30))
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, first), (2, left), (2, own), (2, left), (None, second), (7, None)], key=str)
    assert {(r.doc_id, tuple(r.partners), r.cut_words) for r in substring.report(df).collect()} == {(1, (), 0), (2, (1,), 80), (2, (), 0), (None, (), 0), (7, (), 0)}


def test_passages_that_many_hold(spark):
    rng = np.random.default_rng(12)
    words_of = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared = words_of(60)
    rows_ = [(i, " ".join(words_of(int(rng.integers(0, 40))) + shared + words_of(20))) for i in range(400)] + [(1000, " ".join(words_of(30000)))]
    got = {r.doc_id: r for r in substring.report(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert all(0 in got[i].partners and 60 <= got[i].cut_words <= 62 for i in range(1, 400)) and got[0].cut_words == got[1000].cut_words == 0


def test_passages(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text.split() for r in docs.collect()}
    seen, want = {}, set()
    for i in sorted(text):
        grams = {tuple(text[i][j : j + 50]) for j in range(len(text[i]) - 49)}
        if any(seen.get(g, i) != i for g in grams):
            want.add(i)
        for g in grams:
            seen.setdefault(g, i)
    found = {r.doc_id for r in substring.report(docs).where("n_passages > 0").collect()}
    assert want <= found
    seen = set()
    for r in sorted(substring.cut(docs).collect(), key=lambda r: r.doc_id):
        w = r.text.split()
        grams = {tuple(w[j : j + 50]) for j in range(len(w) - 49)}
        assert not grams & seen
        seen |= grams
    assert substring.report(odd).where("n_passages > 0").count() == 0
    assert substring.report(empty(spark)).count() == 0


def test_passages_of_parts_seen_alone_before(spark):
    rng = np.random.default_rng(5)
    words_of = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, want, nth = [], set(), 0
    for sizes in ([40, 40], [20, 20, 20], [45, 30, 45], [25] * 4):
        for _ in range(6):
            parts = [words_of(n) for n in sizes]
            whole = sum(parts, [])
            overlapping = [whole[i : i + 40] for i in range(0, len(whole) - 20, 20)]
            for p in parts + overlapping:
                rows.append((nth, " ".join(words_of(30) + p + words_of(30))))
                nth += 1
            for copy in range(3):
                rows.append((nth, " ".join(words_of(30) + whole + words_of(30))))
                if copy:
                    want.add((nth, len(whole)))
                nth += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.cut_words) for r in substring.report(df).where("n_passages > 0").collect()}
    assert got == want


def test_fuzzy_passages(spark):
    rng = np.random.default_rng(6)
    words_of = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, at, each = [], {}, 100
    for alike in (0.95, 0.9, 0.85, 0.81):
        for _ in range(each):
            whole = words_of(80)
            copy = [*whole]
            for i in rng.choice(80, round(80 * (1 - alike)), replace=False):
                copy[i] = "changed" + str(i)
            for p in (whole, copy):
                rows.append((len(rows), " ".join(words_of(40) + p + words_of(40))))
            at[len(rows) - 1] = alike
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(at[r.doc_id] for r in substring.report(df).where("n_passages > 0").collect())
    assert found[0.95] == each and found[0.9] >= 0.98 * each and found[0.85] >= 0.92 * each and found[0.81] >= 0.75 * each, found


def test_passages_with_words_put_between(spark):
    rng = np.random.default_rng(7)
    words_of = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for _ in range(60):
        whole = words_of(108)
        copy = [w for i in range(0, 108, 9) for w in (*whole[i : i + 9], f"new{i}")]
        rows += [(len(rows) + j, " ".join(words_of(40) + p + words_of(40))) for j, p in enumerate((whole, copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in substring.report(df).where("n_passages > 0").collect()}
    assert len(found) >= 55 and all(i % 2 for i in found)


def test_lone_matches_are_dropped_only_where_no_passage_can_be():
    rng = np.random.default_rng(4)
    found = 0
    for i in range(600):
        a, b = (rng.integers(0, 1 << 32, n, np.uint64) for n in rng.integers(50, 160, 2))
        x, y = int(rng.integers(0, len(a) - 5)), int(rng.integers(0, len(b) - 5))
        if i % 3:  # alike around the match but for some words, to either side as far as it goes
            left, right = min(x, y, int(rng.integers(0, 60))), min(len(a) - x, len(b) - y, int(rng.integers(6, 66)))
            same = rng.random(left + right) >= rng.choice([0, 0.1, 0.2, 0.25])
            b[y - left : y + right] = np.where(same, a[x - left : x + right], b[y - left : y + right])
        b[y : y + 6] = a[x : x + 6]
        one = lambda v: np.array([v])
        good = substring.align(a, one(0), one(len(a)), b, one(0), one(len(b)), one(0), one(1), one(x), one(y))[2][0]
        may = substring.may_reach(*(substring._beside(substring._sketch(h), len(h), one(at)) for h, at in ((a, x), (b, y))))[0]
        assert may or not good
        found += int(good)
        assert i % 3 or not may  # chance matches are
    assert found > 50


def test_a_match_alone_between_documents_asks_for_no_tiles():
    of = lambda *v: np.array(v, np.int64)
    made = substring._chains_of(of(5, 5, 5, 6), of(1, 2, 2, 1), of(9, 70, 74, 3), of(8, 0, 4, 3), True).to_pylist()
    assert [(r["firsts"], r["tile_firsts"], r["lone_firsts"], r["lone_x"], r["lone_y"]) for r in made] == [([2], [2], [1], [9], [8]), ([], [], [1], [3], [3])]
    made = substring._chains_of(of(5, 6), of(1, 1), of(9, 3), of(8, 3), True).to_pylist()
    assert [(r["firsts"], r["x"], r["lone_x"]) for r in made] == [([], [], [9]), ([], [], [3])]


def test_passages_leave_no_table_that_none_reads_again(spark, tmp_path, monkeypatch):
    from vellum.llm import durable, substring

    monkeypatch.setattr(durable, "folder", lambda _: str(tmp_path))
    shared = [f"s{i}" for i in range(80)]
    texts = [" ".join([f"{d}w{i}" for i in range(90)] + shared + [f"{d}v{i}" for i in range(90)]) for d in range(4)]
    found = substring.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r["cut_words"] for r in found.orderBy("doc_id").collect()] == [0, 80, 80, 80]
    names = {n for at in tmp_path.iterdir() for n in spark.read.parquet(str(at)).columns}
    assert "spans" in names and not names & {"places", "words", "seed", "shared", "held"}
    assert found.count() == 4


def test_chain_takes_the_best_of_crossing_matches():
    x = np.array([0, 8, 16, 24, 30])
    y = np.array([100, 108, 40, 124, 132])
    assert substring.best_chain(x, y) == [0, 1, 3, 4] or substring.best_chain(x, y) == [0, 1, 3]


def test_toxicity():
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice(["thing", "and", "other", "hethan", "ofre"], 60)) for _ in range(200)]
    bad = [" ".join([*rng.choice(["thing", "and", "other", "hethan", "ofre"], 59), "idiotic"]) for _ in range(200)]
    model = toxicity.train([(0, toxicity.windows(t)) for t in clean] + [(1, toxicity.windows(t)) for t in bad])
    scores = toxicity.Scorer(*model)([clean[0], "a thing idiotik and other", "", bad[3]])
    assert scores[3] > 0.5 > scores[0] and scores[1] > 0.5 and scores[2] == 0


def test_toxicity_on_tables(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    with pytest.raises(ValueError):
        toxicity.score(odd, model)
    out = toxicity.score(odd, model, "s", "p").collect()
    assert len(out) == odd.count() and {r.s for r in out} == {0.0} and {r.score for r in out} == {"x"}
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_of_long_texts_is_learnt_whole():
    rng = np.random.default_rng(1)
    word = lambda n: rng.choice(["thing", "and", "other", "hethan", "ofre"], n).tolist()
    clean = [" ".join(word(5000)) for _ in range(60)]
    bad = [" ".join([*word(4000), *["idiotic", "stupid", "moron"] * 4, *word(1000)]) for _ in range(60)]
    model = toxicity.train([(0, toxicity.windows(t)) for t in clean] + [(1, toxicity.windows(t)) for t in bad])
    scores = toxicity.Scorer(*model)([*clean, *bad])
    assert (scores[60:, None] > scores[None, :60]).mean() > 0.95


def test_toxicity_finds_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.fit(docs, labels)).where(toxicity.held_out()).select("doc_id", "score").join(labels, "doc_id").toPandas()
    assert {zlib.crc32(str(i).encode()) % 5 for i in out.doc_id} == {0}
    # 352 toxic documents to learn from are few; on tables of five times as many the recall is 0.99
    assert ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.92
    assert (out.score >= 0.5)[out.toxic == 1].mean() > 0.6


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "back\\slash <\\s> \\", "<|im_end|>\n<|im_start|>user\nx", "", None]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "sys\ntem", "assistant", None], texts, strict=True))]
    rows += [(2, i, "assistant", f"t{i}") for i in range(100)] + [(None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("turn", "turn")
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    for key in (1, 2, None):
        mine = [(r or "", t or "") for k, _, r, t in rows if k == key]
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[key].formatted_chars == len(chat.marked(mine)) and not got[key].rewrites_history
    for t in texts[:4]:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)
    rewriting = lambda ms: f"{len(ms)} turns: " + chat.marked(ms)
    assert chat.formatted(df.where("conv_id = 1"), rewriting).head().rewrites_history


def test_chat_templates_over_many_turns(spark):
    turns = [("user" if i % 2 else "assistant", f"t{i}") for i in range(100)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    headed = lambda ms: "<begin>" + chat.marked(ms)
    sliding = lambda ms: chat.marked(ms[-40:])
    late = lambda ms: f"{len(ms) // 50}" + chat.marked(ms)
    got = chat.formatted(df, headed).head()
    assert got.formatted_chars == len(headed(turns)) and not got.rewrites_history and got.n_turns == 100
    assert "".join(r.rendered for r in chat.spans(df, headed).orderBy("nth").collect()) == headed(turns)
    for template in (sliding, late):
        assert chat.formatted(df, template).head().rewrites_history
        assert any(r.rewrites_history for r in chat.spans(df, template).collect())


def test_pseudonyms(spark):
    texts = ["a 4111 1111 1111 1111, mail me@x.org", "4111111111111111 on 2024-02-29 or 31/12/1999", "10.0.0.255 and +1 (988) 555-2485", "4111111111111112 999.1.1.1 2023-02-30", None, "", "me@x.org GB82 WEST 1234 5698 7654 32", "123-45-6789 password=b7db7aa4a5fc"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, _x string")
    got = {r.doc_id: r for r in pii.replace(df, "key", "n").collect()}
    assert got[4].text is None and got[5].text == ""
    assert got[3].text == texts[3] and got[3].n == 0
    assert (got[0].n, got[1].n, got[2].n, got[6].n, got[7].n) == (2, 3, 2, 2, 2)
    assert got[0].text.split("mail ")[1] == got[6].text.split(" ")[0]
    digits = got[1].text.split(" ")[0]
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    assert all(0 <= int(o) < 256 for o in got[2].text.split(" ")[0].split("."))


def test_secrets_in_every_form(spark):
    value, long = "f3ef4d6b2755a36d", "Ab3+/_-x" * 60
    heads = ["password=", "token = \"", "api_key: '", "{\"secret\" : \"", "passwd:\n  ", "TOKEN\t=\t"]
    ends = ["", "\"", "'", "\"}", "", ""]
    texts = [f"so {h}{value}{e} it is" for h, e in zip(heads, ends, strict=True)]
    texts += [f"token={long}", "password: correcthorse", "password = \"p@ss.w0rd!x\"", "a token is nice: so it goes", "token = \"short\""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r for r in sorted(pii.replace(df, "key", "n").collect(), key=lambda r: r.doc_id)]
    made = set()
    for r, h, e in zip(got, heads, ends, strict=False):
        assert r.n == 1 and value not in r.text and r.text.startswith(f"so {h}") and r.text.endswith(f"{e} it is")
        made.add(r.text[len(f"so {h}") : len(r.text) - len(f"{e} it is")])
    assert len(made) == 1  # equal secrets have equal pseudonyms, whatever stands around them
    assert got[6].n == 1 and not any(long[i : i + 16] in got[6].text[i:] for i in range(0, len(long), 8))
    assert got[7].n == 1 and got[7].text.startswith("password: ") and "horse" not in got[7].text
    assert got[8].n == 1 and got[8].text[:14] == texts[8][:12] + got[8].text[12] + "@" and "w0rd" not in got[8].text
    assert [r.text for r in got[9:]] == texts[9:]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(pii._letters(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("k")).alias("p"))
    assert df.distinct().count() == 1000


def vectors(spark, n=300, d=8):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, d)))]
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, [0.0] * d), (n + 4, [float("nan")] * d), (n + 5, [None] * d), (n + 6, [])]
    return rows, spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")


def test_top_k_is_exact(spark):
    rows, df = vectors(spark)
    v = topk.whole(df)
    got = defaultdict(list)
    for r in topk.search(v, v.where("id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(1024 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows if x and None not in x and np.isfinite(x).all()}
    for q in [i for i in whole if i % 100 == 0]:
        want = sorted(((-int(whole[q] @ x), i) for i, x in whole.items() if i != q))[:10]
        assert got[q] == [(i, -s) for s, i in want]


def test_neighbours(spark):
    rows, df = vectors(spark)
    v = ann.sound(df)
    got = ann.search(v, v.where("id % 50 = 0"), 5).toPandas()
    data = {i: np.array(x, np.float32).astype(float) for i, x in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    hit = total = 0
    for q in [i for i in data if i % 50 == 0]:
        cos = lambda x, q=q: (x @ data[q]) / np.sqrt((x @ x) * (data[q] @ data[q]))
        want = [i for _, i in sorted((-round(cos(x), 12), i) for i, x in data.items() if i != q)[:5]]
        mine = got[got.query_id == q]
        hit, total = hit + len({*want} & {*mine.vec_id}), total + 5
        assert np.allclose(mine.score, [cos(data[i]) for i in mine.vec_id])
    assert hit / total >= 0.9


def test_few_vectors_are_all_found(spark):
    rows_ = [(0, [1.0, 0.0]), (50, [-1.0, 0.1]), (51, [-1.0, -0.1]), (100, [-2.0, 0.0]), (52, [1.0, 1.0, 1.0]), (None, [1.0, 1.0])]
    for n in range(len(rows_) + 1):
        df = spark.createDataFrame(rows_[:n], "vec_id long, embedding array<float>")
        got = Counter(r.query_id for r in ann.search(ann.sound(df), ann.sound(df).where("id % 50 = 0"), 5).collect())
        flat = [i for i, v in rows_[:n] if i is not None and len(v) == 2]
        assert got == Counter({q: len(flat) - 1 for q in flat if q % 50 == 0 and len(flat) > 1})
        whole = topk.search(topk.whole(df), topk.whole(df).where("id % 100 = 0"), 10).collect()
        assert Counter(r.query_id for r in whole) == Counter({q: len(flat) - 1 for q in flat if q % 100 == 0 and len(flat) > 1})


def test_recall_on_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v = ann.sound(df)
    asked = v.where("id % 50 = 0")
    found, want = (f(v, asked, 5).select("query_id", "vec_id") for f in (ann.search, ann.exact))
    assert found.join(want, ["query_id", "vec_id"]).count() >= 0.9 * want.count()


def feistel(values, radices, key):
    """The network in plain Python."""
    half = len(values) // 2
    parts, kinds = [values[:half], values[half:]], [radices[:half], radices[half:]]
    for t in range(1, pii.ROUNDS + 1):
        side = 0 if t % 2 else 1
        seed = f"{key}:{t}:{','.join(map(str, parts[1 - side]))}"
        shift = [int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:12], 16) for i in range(len(parts[side]))]
        parts[side] = [(x + s) % r for x, s, r in zip(parts[side], shift, kinds[side], strict=True)]
    return parts[0] + parts[1]


def test_feistel_equals_brute_force(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    rows_ = []
    for n in (1, 2, 3, 5, 16, 40):
        for _ in range(20):
            radices = rng.choice([1, 10, 26, 256], n).tolist()
            rows_.append(([int(rng.integers(0, r)) for r in radices], radices))
    df = spark.createDataFrame(rows_, "v array<int>, r array<int>")
    for v, r, got in df.select("v", "r", pii.feistel(F.col("v"), F.col("r"), F.lit("key")).alias("f")).collect():
        assert got == feistel(v, r, "key")


def test_numbers_are_linked_across_ways_of_writing(spark):
    same = [
        ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"],
        ["(988) 555-2485", "988-555-2485", "988.555.2485", "+1 (988) 555-2485"],
        ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"],
        ["+44 20 7946 0958", "+442079460958", "+44 (20) 7946-0958"],
        ["2024-02-29", "29.02.2024", "29/02/2024"],
    ]
    texts = [(i, j, f"call {t} now") for i, ts in enumerate(same) for j, t in enumerate(ts)]
    df = spark.createDataFrame(texts, "kind int, nth int, text string").withColumnRenamed("text", "text")
    got = defaultdict(dict)
    for r in pii.replace(df, "key", "n").collect():
        assert r.n == 1 and r.text.startswith("call ") and r.text.endswith(" now"), r
        got[r.kind][r.nth] = r.text[5:-4]
    for i, ts in enumerate(same):
        made = [got[i][j] for j in range(len(ts))]
        if i == 4:
            y, m, d = made[0].split("-")
            assert made[1:] == [f"{d}.{m}.{y}", f"{d}/{m}/{y}"] or made[2] in (f"{d}/{m}/{y}", f"{m}/{d}/{y}")
            continue
        assert all(["".join(c for c in x if not c.isalnum()) == "".join(c for c in t if not c.isalnum()) for x, t in zip(made, ts, strict=True)])
        digits = ["".join(c for c in x if c.isalnum())[-10 if i == 1 else 0 :] for x in made]
        assert len({*digits}) == 1 and digits[0] != "".join(c for c in ts[0] if c.isalnum())


def test_security_numbers_stay_valid(spark):
    numbers = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899, 123) for g in (1, 50, 99) for s in (1, 9999, 4242)]
    df = spark.createDataFrame([(i, f"ssn {t}.") for i, t in enumerate(numbers)], "doc_id long, text string")
    made = [r.text[4:-1] for r in pii.replace(df, "key").orderBy("doc_id").collect()]
    assert len({*made}) == len(numbers)
    for x in made:
        area, group, serial = x.split("-")
        assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and len(x) == 11


def test_pseudonyms_of_long_and_odd_rows(spark):
    long = "word " * 200_000 + "me@x.org"
    df = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (None, "me@x.org", None)], "doc_id long, text string, pseudonymised string")
    out = pii.replace(df, "key", "n")
    assert out.columns == [*df.columns, "n"]
    got = out.collect()
    assert {r.n for r in got} == {1} and got[0].text == got[1].text and got[0].text.split()[-1] == got[2].text and len(got[0].text) == len(long)
    assert pii.replace(empty(spark), "key").count() == 0


def test_passages_whose_seeds_all_stand_first_in_other_documents(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = word(108)
    rows = [(i, " ".join(word(30) + passage[12 * i : 12 * i + 30] + word(30))) for i in range(9)]
    changed = [w if i % 13 != 12 else f"x{i}" for i, w in enumerate(passage)]
    longer = [v for i, w in enumerate(passage) for v in ([w] if i % 13 != 12 else [w, f"y{i}"])]
    rows += [(20, " ".join(word(70) + passage + word(70))), (21, " ".join(word(40) + changed + word(90))), (22, " ".join(word(55) + longer + word(20)))]
    out = {r["doc_id"]: r for r in substring.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(out[i]["n_passages"] == 0 for i in [*range(9), 20])
    assert 20 in out[21]["partners"] and out[21]["cut_words"] >= 100
    assert 20 in out[22]["partners"] and out[22]["cut_words"] >= 100


def test_places_of_common_seeds_are_compared_without_loss():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(50, 97))
        at = int(rng.integers(max(0, n - substring.K - substring.REACH), min(substring.REACH, n - substring.K) + 1))
        a = rng.integers(0, 40, n)
        b = a.copy()
        outside = np.setdiff1d(np.arange(n), np.arange(at, at + substring.K))
        b[rng.choice(outside, n // 5, replace=False)] += 50
        near = []
        for h, before in ((a, int(rng.integers(0, 30))), (b, int(rng.integers(0, 30)))):
            h = np.append(rng.integers(100, 200, before), h).astype(np.uint64)
            frame = {"doc": [1], "n": [len(h)], "sketch": [substring._sketch(h)], "seeds": [np.array([7])], "pos": [np.array([at + before])], "held": [None]}
            near.append(np.frombuffer(next(substring._surroundings([pd.DataFrame(frame)]))["near"][0], np.uint8)[None])
        assert (substring._pairs_of(near[0], substring.REACH, True) @ substring._pairs_of(near[1], substring.SEEN, False).T)[0, 0] >= substring.LEAST


def _around(h, at, seed=7, doc=1, loose=True):
    """The row of `_surroundings` of a place."""
    frame = {"doc": [doc], "n": [len(h)], "sketch": [substring._sketch(h)], "seeds": [np.array([seed])], "pos": [np.array([at])], "held": [None]}
    return next(substring._surroundings([pd.DataFrame(frame)])).assign(own=loose, salt=0)


def test_no_place_that_a_passage_goes_through_is_dropped():
    rng = np.random.default_rng(5)
    one = lambda v: np.array([v])
    passed = dropped = 0
    for i in range(600):
        a = rng.integers(0, 1 << 63, int(rng.integers(50, 130)), dtype=np.int64).astype(np.uint64)
        x = int(rng.integers(0, len(a) - substring.K + 1))
        share = rng.uniform(0, 0.35)
        b, y = [], 0
        for j, w in enumerate(a):
            if j == x:
                y = len(b)
            if x <= j < x + substring.K or rng.random() >= share:
                b.append(w)
            elif rng.random() < 0.8:
                b.append(np.uint64(rng.integers(0, 1 << 62)))
        b = np.concatenate([rng.integers(0, 1 << 62, i % 40, dtype=np.int64).astype(np.uint64), np.array(b, np.uint64)])
        y += i % 40
        good = substring.align(a, one(0), one(len(a)), b, one(0), one(len(b)), one(0), one(1), one(x), one(y))[2][0]
        near = [np.frombuffer(_around(h, at)["near"][0], np.uint8)[None] for h, at in ((a, x), (b, y))]
        may = substring.may_pass(*near)[0]
        assert may or not good
        passed += good
        dropped += not may
    assert passed > 50
    assert dropped > 50


def test_places_that_no_passage_goes_through_are_not_put_out():
    rng = np.random.default_rng(6)
    text = lambda n: rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
    line = text(36)
    # a line of 36 words between others is in 20 documents, and no passage of 50 words is
    rows = [_around(np.concatenate([text(60), line, text(60)]), 75, doc=i) for i in range(20)]
    out = list(substring._alike([pd.concat(rows)]))
    assert sum(map(len, out)) == 0


def test_places_alike_are_compared_with_the_first_of_them():
    rng = np.random.default_rng(7)
    whole = rng.integers(0, 1 << 63, 160, dtype=np.int64).astype(np.uint64)
    changed = whole.copy()
    changed[60] = 1
    kinds = [whole, changed]
    rows = [_around(kinds[i % 2], 75, doc=i) for i in range(40)]
    out = pd.concat(substring._alike([pd.concat(rows)]))
    # the second kind's first is compared with the first kind's, all others with the first of their own
    assert sorted(zip(out["doc"], out["first"], strict=True)) == [(1, 0), *((i, i % 2) for i in range(2, 40))]


def test_places_of_texts_said_over_and_over():
    of, doc = np.array([0, 1, 0, 0, 1, 0]), np.array([1, 1, 1, 2, 2, 2])
    nth, many = substring._copies(of, doc)
    assert nth.tolist() == [0, 0, 1, 0, 0, 1]
    assert many.tolist() == [2, 1, 2, 2, 1, 2]


def test_ranks_are_rows_of_plain_numbers(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "plain numbers"), (2, None)], "doc_id long, text string")
    plan = bpe.encode(docs, "doc_id", "text", P.path("byte_bpe_50k.tiktoken"), P.PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    literals, (ranked, names) = bpe.rank_map(P.path("byte_bpe_50k.tiktoken")), bpe.with_ranks(spark.range(1), P.path("byte_bpe_50k.tiktoken"))
    assert ranked.select(*(F.col(n) == x for n, x in zip(names, literals, strict=True))).first() == (True, True, True)

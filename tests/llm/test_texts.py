"""Operators on texts: encoding, token files, decontamination, line chunks, against brute force and exact round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pathloom.llm import bpe, dac, decontam, linededup

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, ids string, n_tokens int"


def docs(spark, rows):
    """Documents with columns whose names clash with what operators return."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], DOCS)


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_tree_joins_are_exact():
    rng = random.Random(1)
    whole = bpe.TreeEncoder(PATH)
    alphabet = list("abcthein  ABC.!<|>sd\nńéÉßİẞ123\x1c　日ÿÀ,%ªº²") + ["<|endoftext|>", "'re", "the", "ing", " "]
    for n in range(250):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 250)))
        text = text.replace(" ", "") if n % 3 == 0 else text
        small = bpe.TreeEncoder.__new__(bpe.TreeEncoder)
        small.__dict__.update(whole.__dict__)
        small.leaf_chars, small.window_tokens = rng.choice([5, 16, 40]), rng.choice([3, 4, 16])
        want = whole.tokenizer.encode(text, add_special_tokens=False).ids
        assert small.encode(text).tolist() == want
        assert whole._short(text) == np.asarray(want, "<u4").tobytes()


def test_leaves_with_edges_join_exactly():
    rng = random.Random(2)
    enc = bpe.TreeEncoder(PATH, leaf_chars=1000)
    parts = ["the ", "inGest ", "<|endoftext|>", "\n", "É日本", "x" * 700, "a.b,c ", "'re ", " " * 9, "123 "]
    for n in range(60):
        text = "".join(rng.choice(parts[: 3 + n % 8]) for _ in range(rng.randint(300, 2500)))
        assert enc.leaves(text) > 1 or len(text) <= 2000
        assert enc.encode(text).tolist() == reference(text)[0]


def test_round_trip_cases(spark):
    long = "theunsplit" * 900 + " and words, " * 700
    rows = [(1, None), (2, ""), (3, "Hello  wor-ld! <|endoftext|> a"), (4, long), (4, long), (5, "dup"), (5, "dup"), (None, "no id")]
    got = bpe.round_trip(docs(spark, rows), PATH, leaf_chars=500, spread_chars=2000).collect()
    have = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=str)
    want = []
    for i, t in rows:
        ids, text = reference(t)
        want.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert have == sorted(want, key=str)
    assert {r["doc_id"]: r["n_leaves"] for r in got if r["doc_id"] in (1, 3, 4)} == {1: 0, 3: 1, 4: 64}
    assert bpe.round_trip(docs(spark, []), PATH).count() == 0
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode_table(bpe.encode_table(docs(spark, rows), PATH), PATH).collect()}
    assert decoded[3] == reference(rows[2][1])[1] and decoded[1] == ""


@pytest.mark.parametrize("bits", [8, 16])
def test_segments_give_random_access(bits):
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (2 ** rng.uniform(0, 32, n)).astype(np.uint64).clip(0, 2**32 - 1).astype(np.uint32)
        seg = dac.Segment(dac.pack(ids, bits))
        assert len(seg) == n and (seg.slice(0, n) == ids).all()
        for k in rng.integers(0, max(n, 1), 40 if n else 0):
            assert seg.get(int(k)) == ids[k]
            hi = int(rng.integers(k, n)) + 1
            assert (seg.slice(int(k), hi) == ids[k:hi]).all()
    with pytest.raises(ValueError):
        dac.Segment(b"nope" + bytes(20))


def test_an_access_reads_few_bytes():
    ids = np.random.default_rng(4).integers(0, 49_000, 200_000).astype(np.uint32)
    data, seen = dac.pack(ids), []
    seg = dac.Segment(lambda p, n: seen.append(n) or data[p : p + n])
    seen.clear()
    assert seg.get(123_456) == ids[123_456] and sum(seen) < 80
    seen.clear()
    assert (seg.slice(150_000, 150_100) == ids[150_000:150_100]).all() and sum(seen) < 500


def test_files_open_at_any_token(spark, tmp_path):
    dac.write(docs(spark, [(k, f"text number {k} " * (k % 7 + 1)) for k in range(60)]), str(tmp_path / "ids"), PATH, 1, segment_ids=100, partitions=3)
    for r in dac.catalogue(spark, str(tmp_path / "ids")).collect():
        with open(tmp_path / "ids" / r["file"], "rb") as f:
            seg = dac.Segment(lambda p, n, f=f: f.seek(p) >= 0 and f.read(n), r["at"])
            want = [t for i in r["doc_ids"] for t in [*reference(f"text number {i} " * (i % 7 + 1))[0], 1]]
            assert len(seg) == r["n_ids"] == len(want) and [seg.get(k) for k in range(len(seg))] == want


def test_a_catalogue_has_few_files_however_many_ranges(spark, tmp_path):
    rows = [(k, f"text number {k}") for k in range(200)]
    dac.write(docs(spark, rows), str(tmp_path / "ids"), PATH, 1, partitions=60)
    assert len(list((tmp_path / "ids").glob("part-*.pldc"))) > 40
    assert len(list((tmp_path / "ids" / "catalogue").glob("part-*.parquet"))) <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(i for r in dac.catalogue(spark, str(tmp_path / "ids")).collect() for i in r["doc_ids"]) == list(range(200))



def test_token_file(spark):
    rows = [(30, "last one"), (1, "first text"), (2, None), (7, "x" * 40), (7, "x" * 40), (40, "long " * 60_000), (41, "")]
    got = sorted(tuple(r) for r in dac.write_and_digest(docs(spark, rows), PATH, 1).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*reference(t)[0], 1]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert dac.write_and_digest(docs(spark, []), PATH, 1).count() == 0
    assert [tuple(r) for r in dac.write_and_digest(docs(spark, [(5, "x"), (None, "x")]), PATH, 1).select("doc_id", "start").orderBy("start").collect()] == [(None, 0), (5, 2)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(text, items, window):
    w = words(text)
    hit, found = [0] * len(w), set()
    for i, x in items:
        xs = words(x)
        size = min(window, len(xs))
        wins = {tuple(xs[s : s + size]) for s in range(len(xs) - size + 1)} if xs else set()
        for p in range(len(w) - size + 1) if xs else ():
            if tuple(w[p : p + size]) in wins:
                found.add(i)
                hit[p : p + size] = [1] * size
    return len(w), sum(hit), sorted(found)


def affected(text, items, window):
    n, hit, _ = contamination(text, items, window)
    whole = contamination(text, [(i, x) for i, x in items if len(words(x)) >= window], window)[1]
    return bool(whole or (hit and 20 * hit >= n))


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "É", "d1"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 20])))) for k in range(6)] + [(9, None)]
    texts = [" ".join(rng.choice([*vocabulary, "zz"]) for _ in range(rng.choice([0, 5, 60]))) for _ in range(12)]
    texts += ["zz " * 400 + items[5][1], "zz " * 400 + "a"]
    texts += [None, "", "zz " + items[3][1] + "! zz", "zz " + items[3][1] + "! zz"]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contamination(docs(spark, rows), bench, window=4, block_bytes=block, shard_chars=100)
    have = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in got.collect()), key=str)
    assert have == sorted(((i, *contamination(t, items, 4)) for i, t in rows), key=str)
    kept = decontam.remove(docs(spark, rows), bench, window=4, block_bytes=block)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in rows if not affected(t, items, 4))
    assert kept.columns == ["doc_id", "text", "ids", "n_tokens"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(docs(spark, rows), none).where("n_hit > 0").count() == 0
    assert decontam.digest(decontam.find_contamination(docs(spark, []), bench)).count() == 0


def test_a_test_set_of_many_words_is_held_in_arrays():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(50_000)]
    items = [(k, words_bytes(" ".join(rng.choices(vocabulary, k=60)))) for k in range(20_000)]
    test = decontam.TestSuffixes(items)
    held = sum(a.nbytes for a in [*test.low, *test.high, test.owner, test.offset, test.length, test.pairs])
    assert len(test.owner) == 20_000 * 48 and held < 150 * len(test.owner)
    text = b" ".join([b"zz", *items[7][1][5:25], b"zz", *items[19_999][1]]).decode()
    row = decontam.scan([text, "zz " * 50], test)
    assert row[0]["items"] == [7, 19_999] and sum(e - s for s, e in row[0]["spans"]) == 80 and row[0]["longest"] == 60 and not row[1]["items"]


def test_longest_match():
    test = decontam.TestSuffixes([("i", words_bytes("one two three four five six"))], 3)
    row = decontam.scan(["zero two three four five nine"], test)[0]
    assert (row["longest"], row["longest_item"], row["longest_at"], row["spans"]) == (4, "i", 1, [(1, 5)])


def words_bytes(text):
    return decontam.words(text)


def plain_dedup(rows):
    """Line dedup of ``(id, text)`` rows in id order, told without chunks or hashes: a line goes if it and the line before or
    after it stood together before, or if it has 50 words and stood before; stretches of under ten words stay."""
    pairs, longs, want = set(), set(), {}
    for i, t in rows:
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        gone, last = set(), {}
        for a, b in zip(full, full[1:], strict=False):
            pair = (lines[a], lines[b])
            if last.get(pair) == a:
                continue  # overlaps the equal pair before it
            last[pair] = b
            if pair in pairs:
                gone |= {a, b}
            pairs.add(pair)
        for k in full:
            if len(lines[k].split()) >= 50:
                if lines[k] in longs:
                    gone.add(k)
                longs.add(lines[k])
        for a, b in zip(full, full[1:], strict=False):
            if a in gone and b in gone:
                gone |= set(range(a, b))
        stretches, kept = [], []
        for k in sorted(gone):
            if stretches and stretches[-1][-1] == k - 1:
                stretches[-1].append(k)
            else:
                stretches.append([k])
        for s in stretches:
            if sum(len(lines[k].split()) for k in s) < 10:
                kept += s
        gone -= set(kept)
        want[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return want


def test_line_chunks(spark):
    passage = "\n".join(f"shared line number {k} with some words of its own" for k in range(9))
    one = "a single line of a great many words " * 8
    medium = "a single line of some words that comes again and again in many other texts as boilerplate may do"
    rows = [(1, f"start one\n{passage}\nend one"), (2, f"begin two here\nand more\n{passage}\nfinish two"), (3, "unique\ntext"), (4, None), (5, ""), (6, one), (7, "x\n" + one), (8, f"start one\n{passage}\nend one"), (9, f"p\n{medium}\nq"), (10, f"r\n{medium}\ns"), (11, "of two lines the first has these words\nand the second has those"), (12, "x y\nof two lines the first has these words\n\nand the second has those\nz")]
    frame = spark.createDataFrame([(i, t, "src", 5) for i, t in rows], "doc_id long, text string, _n_removed string, n_chars long")
    got = {r["doc_id"]: r for r in linededup.dedup(frame).collect()}
    want = plain_dedup(rows)
    assert {i: r["text"] for i, r in got.items()} == want
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "begin two here\nand more\nfinish two"
    assert got[10]["text"] == rows[9][1] and got[12]["text"] == "x y\nz" and got[8]["_n_by_chunk"] > 2 and got[7]["_n_by_line"] == 1
    assert got[7]["text"] == "x" and got[3]["text"] == "unique\ntext" and got[8]["text"] == ""
    assert got[2]["n_chars"] == len(got[2]["text"]) and got[4]["text"] is None
    assert linededup.dedup(frame.limit(0)).count() == 0


def test_chunk_boundaries_resist_shifts():
    lines = [f"line {k} " + "word " * (k % 5 + 3) for k in range(60)]

    def chunk_hashes(x):
        return {h for h, k in zip(*(v.tolist() for v in linededup.pieces("\n".join(x))[2:]), strict=True) if k == linededup.CHUNK}

    a, b = chunk_hashes(lines), chunk_hashes(["new line at the top", *lines[3:30], "one in the middle", *lines[30:]])
    assert len(a) > 8 and len(a & b) >= len(a) - 4


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_against_the_plain_model(spark, seed):
    """Texts of few distinct lines: many repeats, overlaps, blank and long lines, null and repeated rows."""
    rng = random.Random(seed)
    stock = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 6, 12, 55]))) for _ in range(14)] + ["", "  "]
    texts = ["\n".join(rng.choice(stock) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, ""]
    rows = list(enumerate(texts))
    got = linededup.dedup(docs(spark, [*rows, rows[3]])).collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain_dedup(rows) and len(got) == len(rows) + 1
    assert all(r["_n_removed"] == r["_n_by_chunk"] + r["_n_by_window"] + r["_n_by_line"] for r in got)


def test_equal_hashes_of_different_bytes_stay(spark, monkeypatch):
    rows = [(1, "first line of the first text\nand its second line here"), (2, "other line of another text\nand its second one here")]
    plain = linededup.dedup(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in plain} == dict(rows)
    found = linededup.removed(rows[0][1].split("\n"), [(0, 2, 1)])
    assert found.tolist() == [1, 1] and linededup.removed(["a b", "c d"], [(0, 2, 1)]).tolist() == [-1, -1]


def test_repeated_passages_of_short_lines_go_whole(spark):
    rng = random.Random(12)
    fresh = iter(range(10**6))

    def passage(shape):
        return [" ".join(f"p{next(fresh)}" for _ in range(n)) if n else "" for n in shape]

    shapes = [[18] * 3, [3] * 17, [1] * 50, [19, 2, 19, 2, 19], [5, 0, 30, 0, 5, 0, 30, 0, 4], *([rng.randint(1, 19) for _ in range(20)] for _ in range(8))]
    passages = [passage(x) for x in shapes]
    rows = []
    for k in range(8):
        lines = passage([rng.choice([4, 30])])
        for p in rng.sample(passages, len(passages)):
            lines += p + passage([rng.choice([4, 9, 30]) for _ in range(rng.randint(1, 4))])
        rows.append((k, "\n".join(lines)))
    counts = {}
    for _, t in rows:
        for x in t.split("\n"):
            counts[x] = counts.get(x, 0) + 1
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got == plain_dedup(rows)
    for k, t in rows[1:]:
        assert [x for x in got[k].split("\n") if x] == [x for x in t.split("\n") if counts[x] == 1 and x]


def test_short_repeats_inside_one_text_stay(spark):
    rows = [(1, "0\n" * 11), (2, "a b c\nd e f\nnew one here"), (3, "a b c\nother words\nd e f")]
    assert {r["doc_id"]: r["text"] for r in linededup.dedup(docs(spark, rows)).collect()} == dict(rows)

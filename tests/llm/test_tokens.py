"""Token counts, token files and byte-level BPE against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from engram.llm import bpe, encoding, queries, token_counts, token_store
from engram.llm.encoding import Encoder
from engram.storage import new_folder

from .fixtures import awkward, empty

PARTS = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'", "'s", "'re", "1", "²", "!", "é", "日", "　", "word", "ab,", "c.\nD", "\n ", "_", "<|endoftext|>", "😀"]


def texts(n, seed, most=80, parts=PARTS):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranks():
    return bpe.Codec.of(bpe.RANKS, bpe.PATTERN)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def encoded(encoder, some):
    flat, before = encoder.encode(pa.array(some, pa.string()))
    assert encoder.encode(pa.array(some, pa.string()), ids=False)[1].tolist() == before.tolist()
    return [flat[a:b].tolist() for a, b in zip(before, before[1:])]


LETTERS = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x530), 0x1680, 0x200B, 0x2028, 0x3000]]


@pytest.mark.parametrize("parts", [PARTS, PARTS[:-2], LETTERS + [" "] * 60 + ["'", "\n"] * 20 + list("abcdefghijklmnopqrstuvwxyz") * 5])
def test_encoder_is_the_library(library, parts):
    """The library as it is loaded, on whole texts; added tokens included."""
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    some = [None, "", *texts(3000, 2, 30, parts), "a <|endoftext|> b", "<|endoftext|>"]
    assert e.cuts
    for got, t in zip(encoded(e, some), some):
        assert got == ids_of(library, t), repr(t)


def test_encoder_of_another_file():
    """A file with other steps than byte-level pieces is left to the library."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    e, some = Encoder(path), texts(200, 6, 30)
    assert not e.cuts and encoded(e, some) == [ids_of(Tokenizer.from_file(path), t) for t in some]


def test_encoder_memo_is_bounded(library, monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_ENTRIES", 20)
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts(200, 3):
        assert encoded(e, [t])[0] == ids_of(library, t) and len(e.known) <= 20


def test_encoder_cuts_long_texts(library, monkeypatch):
    monkeypatch.setattr(encoding, "SEGMENT", 300)
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    some = ["".join(texts(1, 9, 4000, PARTS[:-2])), "x" * 70000 + " y " + "z " * 3000, "", "a b", " " * 5000]
    assert encoded(e, some) == [ids_of(library, t) for t in some]
    assert len(encoding.segments(np.frombuffer(some[1].encode(), np.uint8), 300)) > 10


def brute_limits(lengths):
    out = []
    for limit, n in Counter(lengths).items():
        within = [x for x in lengths if x <= limit]
        over = [x for x in lengths if x > limit]
        out.append((limit, n, len(over), sum(over), len(within), sum(within), sum(min(x, limit) for x in lengths)))
    return Counter(out)


def test_token_counts_awkward(spark, library):
    lengths = [len(ids_of(library, r.text)) for r in awkward(spark).select("text").collect()]
    h = token_counts.length_histogram(token_counts.encoded_lengths(awkward(spark)))
    assert Counter(map(tuple, token_counts.context_limits(h).collect())) == brute_limits(lengths)
    got = token_counts.answers(h, 10, 0.5)
    assert got["docs"] == len(lengths) and got["tokens"] == sum(lengths) and got["truncated_tokens"] == sum(min(x, 10) for x in lengths)
    assert got["quantile"] == sorted(lengths)[-(-len(lengths) // 2) - 1]


def test_token_counts_query(spark, sf_dir, library):
    lengths = [len(ids_of(library, r.text)) for r in queries.table(spark, sf_dir, "documents").collect()]
    assert Counter(map(tuple, queries.op3_token_counts(spark, sf_dir).collect())) == brute_limits(lengths)


def stored(rows, library):
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, out = 0, []
    for r in order:
        ids = [*ids_of(library, r.text), 2]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return Counter(out)


@pytest.mark.parametrize("bits", [False, True])
def test_token_store_awkward(spark, library, bits):
    frame = awkward(spark)
    got = token_store.round_trip(frame, bits=bits)
    assert Counter(map(tuple, got.collect())) == stored(frame.select("doc_id", "text").collect(), library)


def test_token_store_query(spark, sf_dir, library):
    want = stored(queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect(), library)
    assert Counter(map(tuple, queries.op4_token_store(spark, sf_dir).collect())) == want


def test_token_store_ids(spark, library):
    frame = awkward(spark).where("doc_id = 9")
    assert token_store.round_trip(frame, with_ids=True).first().ids == [*ids_of(library, frame.first().text), 2]


def test_token_store_of_one_id(spark, library):
    """Rows of one id, or none, are dealt by their texts; a folder without a scheme is Spark's; others are refused at once."""
    rows = [(k % 2 or None, f"text {i}") for k in range(2) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_folder(spark, "plain").removeprefix("file:").replace("//", "/")
    got = token_store.round_trip(frame, folder=folder).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(ids_of(library, t)) + 1) for i, t in rows)
    assert sorted(r.start for r in got)[0] == 0 and len({r.start for r in got}) == 100
    assert max(r.start for r in got if r.doc_id is None) < min(r.start for r in got if r.doc_id == 1)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./x", "file:///tmp")
    with pytest.raises(ValueError, match="Arrow can open"):
        token_store.write_tokens(frame, "viewfs://t/x/y")


def test_planes():
    r = np.random.default_rng(0)
    for n in (1, 7, 64, 1000):
        ids = r.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        for bits in (False, True):
            assert (token_store.from_planes(token_store.to_planes(ids, bits), n) == ids).all()


def test_token_file_blocks_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 10)
    path = tmp_path / "x.tok"
    with open(path, "wb") as f:
        w = token_store.Writer(f)
        for k in range(7):
            w.add(np.arange(k * 3, dtype="<u4"))
        w.close(pa.table({"id": list(range(7)), "n_tokens": [k * 3 for k in range(7)]}))
    documents, blocks = token_store.read_file(pa.fs.LocalFileSystem().open_input_file(str(path)))
    assert documents.num_rows == 7 and np.concatenate(list(blocks)).tolist() == [x for k in range(7) for x in range(k * 3)]
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(Exception):
        token_store.read_file(pa.fs.LocalFileSystem().open_input_file(str(path)))


def test_files_of_failed_attempts_are_not_read(spark, library):
    folder = new_folder(spark, "attempts")
    manifest = token_store.write_tokens(awkward(spark), folder)
    fs, path = token_store.open_path(folder)
    with fs.open_output_stream(f"{path}/part-000000-broken.tok") as f:
        f.write(b"half a file")
    got = token_store.read_tokens(spark, manifest)
    assert Counter(map(tuple, got.collect())) == stored(awkward(spark).select("doc_id", "text").collect(), library)


def bpe_brute(codec, text):
    ids = np.array(codec.library.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_pre_tokens_stitch(ranks):
    r = random.Random(4)
    for t in texts(2000, 5, 150):
        assert bpe.pre_tokens(t, ranks, r.choice([12, 20, 33]), r.choice([5, 8, 11])) == ranks.pattern.findall(t), repr(t)
    long = "x" * 3000 + " y" * 2000 + " " * 2000 + "z'll" * 1500
    for chunk, overlap in ((100, 20), (1000, 100), (64, 33)):
        assert bpe.pre_tokens(long, ranks, chunk, overlap) == ranks.pattern.findall(long)


def test_pre_tokens_of_usual_texts_are_stitched(ranks, monkeypatch):
    """Many of the documents go through overlapping chunks; few need a second scan."""
    import pyarrow.parquet as pq

    calls = {"stitch": 0, "rescan": 0}
    plain = bpe.stitch

    def counted(scans, size, rescan):
        def again(a, b):
            calls["rescan"] += 1
            return rescan(a, b)

        calls["stitch"] += 1
        return plain(scans, size, again)

    monkeypatch.setattr(bpe, "stitch", counted)
    some = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    for t in some:
        assert bpe.pre_tokens(t or "", ranks) == ranks.pattern.findall(t or "")
    assert calls["stitch"] > 100 and calls["stitch"] == sum(len(t or "") > bpe.CHUNK for t in some)


def test_bpe_awkward(spark, ranks):
    rows = awkward(spark).select("doc_id", "text").collect()
    want = Counter((r.doc_id, *bpe_brute(ranks, r.text)) for r in rows)
    assert Counter(map(tuple, bpe.encode(awkward(spark)).collect())) == want


def test_bpe_long_texts_over_many_rows(spark, ranks):
    """Texts above a limit are scanned in rows and stitched; null and repeated ids stay apart."""
    rows = awkward(spark).select("doc_id", "text").collect()
    want = Counter((r.doc_id, *bpe_brute(ranks, r.text)) for r in rows)
    got = bpe.encode(awkward(spark), long_chars=20, row_chars=300, overlap=40)
    assert Counter(map(tuple, got.collect())) == want
    texts = awkward(spark).withColumn("doc_id", F.concat(F.lit("b"), F.col("doc_id").cast("string")))
    got = bpe.encode(texts, long_chars=20, row_chars=300, overlap=40)
    assert Counter(map(tuple, got.collect())) == Counter({(x[0] and f"b{x[0]}", *x[1:]): n for x, n in want.items()})


def test_bpe_query(spark, sf_dir, ranks):
    rows = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert Counter(map(tuple, queries.op5_byte_bpe(spark, sf_dir).collect())) == Counter((r.doc_id, *bpe_brute(ranks, r.text)) for r in rows)


def test_bpe_values(spark, ranks):
    out = {r.doc_id: r for r in bpe.encode(awkward(spark), digests=False).collect()}
    assert bytes(out[9].decoded).decode().startswith("Grüße") and len(out[9].ids) == 4 * out[9].n_tokens and bytes(out[2].ids) == b""


def test_empty(spark):
    h = token_counts.length_histogram(token_counts.encoded_lengths(empty(spark)))
    assert token_counts.context_limits(h).count() == 0 and token_counts.answers(h, 5)["docs"] == 0
    assert token_store.round_trip(empty(spark)).count() == 0
    assert bpe.encode(empty(spark)).count() == 0

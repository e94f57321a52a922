"""Byte-pair encoding, token files, SimHash, media and WARC against plain versions and round trips."""

from __future__ import annotations

import base64
import hashlib
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickspark.llm import bpe, common, jaccard, media, simhash, tokens, warc
from tickspark.llm.common import UnionFind, connected_components, filesystem

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, P.PATTERN)


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_encoding_random(texts):
    made, wanted = test_encoding_random.encoder, test_encoding_random.reference
    assert [ids_of(x) for x in made.encode(texts)] == [wanted.encode_ordinary(x) for x in texts]


test_encoding_random.encoder = bpe.Encoder(RANKS, P.PATTERN)
test_encoding_random.reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("long", [64, 5, 1])
def test_replay_waits_for_lower_ranks(long, monkeypatch):
    """Ranks whose merges create pairs of lower rank: the piece must turn to those first, as pair-by-pair merging does."""
    monkeypatch.setattr(bpe.Replay, "LONG", long)
    rng = np.random.default_rng(1)
    for _ in range(60):
        ranks = {bytes([k]): k for k in range(256)}
        made = [bytes([c]) for c in b"abc"]
        for r in rng.permutation(40):
            new = made[rng.integers(len(made))] + made[rng.integers(len(made))]
            if new not in ranks and len(new) < 9:
                ranks[new] = 256 + int(r)
                made.append(new)
        if len(set(ranks.values())) != len(ranks):
            continue
        pieces = [bytes(rng.choice(list(b"abc"), rng.integers(1, 14))) for _ in range(40)]

        def plain(piece, ranks=ranks):
            if piece in ranks:
                return [ranks[piece]]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while True:
                best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 30, 0))
                if best[0] == 1 << 30:
                    return [ranks[x] for x in parts]
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

        assert [ids_of(x) for x in bpe.Replay(ranks)(pieces)] == [plain(p) for p in pieces]


def test_small_memo_changes_nothing(encoder, reference, monkeypatch, documents):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 30_000)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 500)
    monkeypatch.setattr(bpe, "RUN_PIECES", 70)
    small = bpe.Encoder(RANKS, P.PATTERN)
    texts = [r.text for r in documents.limit(40).collect()]
    for i in range(0, 40, 5):
        assert [ids_of(x) for x in small.encode(texts[i : i + 5])] == [reference.encode_ordinary(t) for t in texts[i : i + 5]]
        assert small.held <= 30_000


def test_encode_and_decode_odd(odd, none, reference):
    out = bpe.digest(bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS)).collect()
    wanted = sorted((-1 if r.doc_id is None else r.doc_id, len(i := reference.encode_ordinary(r.text or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == wanted
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd, RANKS, P.PATTERN).collect()) == wanted
    assert bpe.digest(bpe.decode(bpe.encode(none, RANKS, P.PATTERN), RANKS)).count() == 0
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(steps).tolist()
    made = tokens.EliasFano.from_bytes(tokens.EliasFano.of(values).to_bytes())
    assert made.all().tolist() == values
    assert [made.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        made.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(tokens.EliasFano.of(values).to_bytes()) < 100_000 * 13 / 8


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_encoder(text):
    made = test_word_encoder.made
    assert np.frombuffer(made.encode([text])[0], made.kind).tolist() == test_word_encoder.library.encode(text, add_special_tokens=False).ids


test_word_encoder.made = tokens.WordEncoder(WORDS)
test_word_encoder.library = Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", " ", "\n", "\u0308", "\u030c", "\u0338", "T", "J", "I", "word", "Word.", "it's", "42", "\xa0"]), st.text(max_size=4)), max_size=12))
def test_word_encoder_added_tokens_and_marks(parts):
    text = "".join(parts)
    made = test_word_encoder.made
    assert np.frombuffer(made.encode([text])[0], made.kind).tolist() == test_word_encoder.library.encode(text, add_special_tokens=False).ids


def test_word_encoder_small_memo(documents, monkeypatch):
    monkeypatch.setattr(tokens.WordEncoder, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(tokens.WordEncoder, "LONG", 300)
    made = tokens.WordEncoder(WORDS)
    texts = [r.text or "" for r in documents.limit(60).collect()]
    for i in range(0, 60, 7):
        got = [np.frombuffer(x, made.kind).tolist() for x in made.encode(texts[i : i + 7])]
        assert got == [test_word_encoder.library.encode(t, add_special_tokens=False).ids for t in texts[i : i + 7]]
        assert made.held <= 20_000


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    spec = json.load(open(WORDS, encoding="utf-8"))
    assert tokens.word_by_word(spec)
    spec["added_tokens"][0]["rstrip"] = True
    assert not tokens.word_by_word(spec)
    (tmp_path / "t.json").write_text(json.dumps(spec))
    text = "a <|startoftext|>  b c"
    made = tokens.WordEncoder(str(tmp_path / "t.json"))
    assert np.frombuffer(made.encode([text])[0], made.kind).tolist() == Tokenizer.from_file(str(tmp_path / "t.json")).encode(text, add_special_tokens=False).ids


def test_token_files_odd(spark, odd, none):
    library = test_word_encoder.library
    found = tokens.digest(tokens.round_trip(odd, WORDS)).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    at, wanted = 0, []
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found), key=lambda x: x[1]) == wanted
    assert tokens.round_trip(none, WORDS).count() == 0


def test_token_files_roll_and_select(spark, documents, tmp_path):
    manifest = tokens.write(documents, f"file://{tmp_path}/t", WORDS, 2, file_ids=3000)
    files = manifest.orderBy("part", "roll").collect()
    assert len(files) > 3 and sum(r.docs for r in files) == documents.count()
    rows = tokens.read(spark, manifest).orderBy("start").collect()
    stored = tokens.TokenFile(files[1].file)
    first = files[0].docs
    assert [stored.document(i).tolist() for i in range(stored.docs)] == [np.frombuffer(r.ids, "<u4").tolist() for r in rows[first : first + stored.docs]]
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in documents.collect())


def plain_fingerprint(text, n=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values: dict, near) -> dict:
    sets, keys = UnionFind(), list(values)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(values[a], values[b]):
                sets.join(a, b)
    return {k: sets.find(k) for k in keys}


def test_fingerprints_odd(odd):
    got = sorted(((r.doc_id or -1), r.fp % 2**64) for r in simhash.fingerprints(odd).collect())
    assert got == sorted(((r.doc_id or -1), plain_fingerprint(r.text)) for r in odd.collect())


@pytest.mark.parametrize("shard_rows", [200_000, 20, 3])
def test_near_duplicates(documents, shard_rows):
    rows = documents.limit(120)
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows.collect()}
    wanted = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, shard_rows=shard_rows).collect()}
    assert got == wanted


def test_links_of_dense_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(150)} | {0, 1, 7, 2**64 - 1}
    signed = {x - 2**64 if x >= 2**63 else x: x for x in fps}
    df = spark.createDataFrame([(k,) for k in signed], "fp long")
    found = simhash.links(df, 2)
    sets, wanted = UnionFind(), plain_components(signed, lambda a, b: (a ^ b).bit_count() <= 2)
    for r in found.collect():
        assert (signed[r.src] ^ signed[r.dst]).bit_count() <= 64
        sets.join(r.src, r.dst)
    assert {k: sets.find(k) for k in signed} == wanted


def test_near_duplicates_odd(odd, none):
    found = simhash.near_duplicates(odd)
    assert found.count() == odd.count()
    empty = {r.component_id for r in found.collect() if r.doc_id in (4, 12, 13)}
    assert empty == {3}  # id 3 has an empty text, 4 none, 12 and 13 blanks only
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("block", "group"), [(1024, 64), (8, 64), (8, 3)])
def test_near_copies_by_jaccard(spark, odd, none, monkeypatch, block, group):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "GROUP", group)
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    shared, texts = word(60), []
    for n in (3, 12, 60, 200, 200):
        base = word(n)
        for k in range(14):
            t = list(base)
            for _ in range(k // 3):
                t[rng.integers(len(t))] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(t if k % 2 else t[: len(t) - k // 4]))
    texts += [" ".join(shared + word(40)) for _ in range(12)] + ["", None, " "]
    sets = {i: frozenset(tuple((t or "").split()[j : j + 5]) for j in range(max(1, len((t or "").split()) - 4))) for i, t in enumerate(texts)}
    wanted = plain_components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(rows).collect()} == wanted
    loose = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert len(set(wanted.values())) < len(set(loose.values()))  # two bits lose near copies
    assert jaccard.near_duplicates(odd).count() == odd.count() and jaccard.near_duplicates(none).count() == 0


def test_common_lines_make_no_group(spark, monkeypatch):
    """Texts that share a line only are no candidates, however many; near copies among them are found."""
    monkeypatch.setattr(jaccard, "GROUP", 8)
    rng = np.random.default_rng(8)
    line, own = [f"c{i}" for i in range(12)], lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = [line + own(14) for _ in range(300)]
    texts += [[*t[:-1], "other"] for t in texts[:5]]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = common.connected_components(jaccard.candidates(rows.select("text"), 5, (4, 5)))
    assert max(r["count"] for r in found.groupBy("component").count().collect()) <= 20
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(rows).collect()} == {i: i % 300 for i in range(305)}


def test_near_copies_make_rows_in_proportion(spark, monkeypatch):
    """Twice as many near copies of one text make about twice the rows on the way to candidates, not four times."""
    rng, rows = np.random.default_rng(12), {}
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    copies = [(i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])) for i, at in enumerate(rng.integers(0, 300, 60).tolist())]
    kept = jaccard.written

    def counted(df, what):
        out = kept(df, what)
        rows[what] = max(rows.get(what, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    most = []
    for n in (30, 60):
        rows.clear()
        edges = jaccard.candidates(spark.createDataFrame(copies[:n], "doc_id long, text string").select("text"), 5, (4, 5))
        assert connected_components(edges).groupBy("component").count().first()["count"] == n
        most.append(max([edges.count(), *rows.values()]))
    assert most[1] <= 3 * most[0]


@pytest.mark.parametrize("most", [1, 3, 100])
def test_shared_keys(most):
    """Keys of several marks, over every division into parts; a key of more than `most` marks has most + 1."""
    rng = np.random.default_rng(most)
    for _ in range(200):
        n = int(rng.integers(0, 50))
        pairs = sorted(zip(rng.integers(0, 5, n).tolist(), rng.integers(0, 12, n).tolist(), strict=True))
        cuts = [0, *sorted(rng.integers(0, n + 1, 4).tolist()), n]
        columns = [np.array([p[k] for p in pairs], np.int64) for k in (0, 1)]
        parts = [(columns[0][a:b], columns[1][a:b], columns[0][a:b].astype(np.int32)) for a, b in zip(cuts, cuts[1:], strict=False)]
        marks = {k: {m for key, m in pairs if key == k} for k, _ in pairs}
        wanted = [(k, m, k, min(len(marks[k]), most + 1)) for k in sorted(marks) if len(marks[k]) > 1 for m in sorted(marks[k])]
        assert [tuple(map(int, x)) for p in jaccard.shared(parts, most) for x in zip(*p, strict=True)] == wanted


def test_near_dedup_by_simhash(spark, monkeypatch):
    """SimHash nominates near copies by itself; the exact comparison turns down those it should not have."""
    import corpus_pipeline

    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    apart = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
    near = next(t for k in range(500) if 0 < apart(t := " ".join([*base[:-1], f"x{k}"]), " ".join(base)) <= 2)
    cycle = "a b c " * 50
    texts = [" ".join(base), near, cycle, cycle + "p q r s t u", "far from all of them by every measure"]
    assert apart(texts[2], texts[3]) <= 2
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()} == {0, 2, 3, 4}
    nothing = spark.createDataFrame([], "src long, dst long")
    monkeypatch.setattr(jaccard, "candidates", lambda *_: nothing)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()} == {0, 2, 3, 4}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(3)
    n = 300
    pairs = {"chain": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "random": [tuple(map(int, x)) for x in rng.integers(0, n, (200, 2))], "none": []}[kind]
    sets = UnionFind()
    for a, b in pairs:
        sets.join(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long").repartition(8)).collect()}
    assert got == {x: sets.find(x) for p in pairs if p[0] != p[1] for x in p}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_image_round_trip(data):
    payload, n = media.from_image(media.to_image(data))
    assert n == len(data) and payload == media.pad(data) and len(payload) % 64 == 0 and payload


def test_damaged_images():
    image = bytearray(media.to_image(b"abc"))
    image[-20] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        media.from_image(bytes(image))


def plain_feature(payload):
    """Sum of the bytes, and how many of them lie in each eighth of 0..255."""
    return f"sum={sum(payload)};hist=" + ",".join(str(sum(32 * k <= b < 32 * k + 32 for b in payload)) for k in range(8))


def test_media_odd(odd, none):
    out = media.round_trip(odd).collect()
    wanted = []
    for r in odd.collect():
        payload = media.pad((r.text or "").encode())
        wanted.append((r.doc_id or -1, len((r.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), plain_feature(payload)))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in out) == sorted(wanted)
    assert len({r.media_sha256 for r in out}) == len({r.payload_sha256 + str(r.n_bytes) for r in out})
    assert media.round_trip(none).count() == 0


def test_archives_are_zip_files_and_ranges_cover_them(spark, documents, tmp_path, monkeypatch):
    manifest = media.write(documents, f"file://{tmp_path}/m").collect()
    with zipfile.ZipFile(manifest[0].archive.removeprefix("file://")) as z:
        assert z.testzip() is None and len(z.namelist()) == manifest[0].members
    reader = media.ArchiveReader({"path": f"file://{tmp_path}/m", "rangeBytes": "50000"})
    parts = reader.partitions()
    assert len(parts) > 3
    rows = [n for p in parts for b in reader.read(p) for n in b.column("name").to_pylist()]
    assert len(rows) == len(set(rows)) == documents.count()


def test_files_of_other_attempts_do_not_count(spark, documents, tmp_path):
    """A second attempt of a task writes files of names of its own; the manifest says which ones are read."""
    few, folder = documents.limit(20), f"file://{tmp_path}/m"
    media.write(few, folder)
    orphan = media.ArchiveWriter(f"{folder}/part-000000-0000-late.zip")
    orphan.add("00000000-1.png", media.to_image(b"late"))
    orphan.close()
    assert media.features(media.read(spark, folder)).count() == 20
    a, b = (tokens.write(few, f"file://{tmp_path}/t", WORDS, 2) for _ in range(2))  # both attempts in one folder
    assert not {r.file for r in a.collect()} & {r.file for r in b.collect()}
    assert tokens.read(spark, a).count() == tokens.read(spark, b).count() == 20


def test_members_are_retried_on_their_own(spark, documents, tmp_path, monkeypatch):
    manifest = media.write(documents.limit(5), f"file://{tmp_path}/m").collect()
    fs, at = filesystem(manifest[0].archive)
    with open(at, "rb") as f:
        data = bytearray(f.read())
    entries = media.directory(fs.open_input_file(at))
    data[entries[2][0] + 90] ^= 255  # breaks one member for good
    with open(at, "wb") as f:
        f.write(data)
    calls, real = [], media.ArchiveReader.member

    def once(file, offset, size, crc):
        calls.append(offset)
        if offset == entries[1][0] and calls.count(offset) == 1:
            raise OSError("lost")
        return real(file, offset, size, crc)

    monkeypatch.setattr(media.ArchiveReader, "member", staticmethod(once))
    reader = media.ArchiveReader({"path": f"file://{tmp_path}/m", "retries": "2"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["media"] is None for r in rows] == [False, False, True, False, False] and rows[2]["error"]
    assert [calls.count(e[0]) for e in entries] == [1, 2, 3, 1, 1]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, k string, digest int")


def test_warc_odd(spark):
    big, other = "<p>é" + "x" * 70_000, "<p>" + "y" * 200
    rows = [(5, "http://a/\r\nX: y", big, "k", 1), (2, None, big, "k", 1), (9, "u", "short", "k", 1), (8, "u", "short", "k", 1), (None, "u", other, "k", 1), (4, "u", None, "k", 1), (3, "u", "", "k", 1), (7, "u", other, "k", 1), (7, "u", other, "k", 1), (1, "u", "0\r\n\r\n" * 50, "k", 1)]
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.round_trip(pages_of(spark, rows)).collect()}
    digest = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    wanted = {(5, "revisit", 2, *digest(big)), (2, "response", None, *digest(big)), (9, "response", None, *digest("short")), (8, "response", None, *digest("short")), (None, "revisit", 7, *digest(other)), (4, "response", None, *digest("")), (3, "response", None, *digest("")), (7, "response", None, *digest(other)), (1, "response", None, *digest("0\r\n\r\n" * 50))}
    assert got == wanted
    assert warc.round_trip(pages_of(spark, rows)).count() == len(rows)
    assert warc.round_trip(pages_of(spark, rows).limit(0)).count() == 0


def test_segments_cross_files(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}" + "ab" * 3000, "k", 1) for i in range(6)]
    manifest = warc.write(pages_of(spark, rows).coalesce(1), f"file://{tmp_path}/w", file_bytes=300, segment_bytes=1000)
    files = manifest.collect()
    assert len(files) > 6
    raw = warc.parsed(manifest)
    assert raw.filter("segment > 1").count() == 6 * 6 and raw.filter("total IS NOT NULL").count() == 6
    got = {r.page_id: bytes(r.payload) for r in warc.read(manifest).collect()}
    assert got == {r[0]: r[2].encode() for r in rows}


def test_long_repeated_payloads(spark):
    """Payloads of many segments, repeated: one response, revisits without a payload, also when the map of digests is full."""
    text = "".join(f"<p>é {i}</p>" for i in range(20_000))
    rows = [(i, "u", text if i % 4 else text[:-1], "k", 1) for i in range(12)] + [(3, "u", text, "k", 1)]
    for bits in (24, 6):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(common, "MAP_BITS", bits)
            got = sorted((r.page_id, r.record_type, r.refers_to if r.refers_to is not None else -1, r.payload_bytes) for r in warc.round_trip(pages_of(spark, rows)).collect())
        size = len(text.encode())
        wanted = [(i, "response", -1, n) if i == first else (i, "revisit", first, n) for i in range(12) for first, n in ((1, size) if i % 4 else (0, size - 1),)]
        assert got == sorted([*wanted, (3, "revisit", 1, size)])


def test_missing_segments_raise():
    with pytest.raises(ValueError):
        warc.joined("o", [(1, None, b"ab"), (3, 4, b"cd")])
    with pytest.raises(ValueError):
        warc.joined("o", [(1, None, b"ab"), (2, 5, b"cd")])
    with pytest.raises(ValueError):
        warc.joined("o", [(1, None, b"ab")])
    assert warc.joined("o", [(1, None, b"ab"), (2, 4, b"cd")]) == b"abcd"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing(payload, size):
    assert warc.http_payload(warc.http_block(payload, size)) == payload


def test_broken_framing():
    with pytest.raises(ValueError):
        warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabcd\r\n0\r\n\r\n")


def test_ranks_file_is_read_whole():
    with open(RANKS, "rb") as f:
        assert len(bpe.load_ranks(RANKS)) == sum(1 for _ in f)
    assert bpe.load_ranks(RANKS)[base64.b64decode(b"IA==")] >= 0

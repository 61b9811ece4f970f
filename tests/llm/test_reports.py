"""The registered reports against brute force on whole tables, and odd tables for all of them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremolite.llm import bpe, chat, common, langid, licenses, media, mixing, near_dedup, queries, secrets, sharding, topk

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def base_spans(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, p, group, least) in enumerate(BASE) for m in p.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def brute_entropy(text, allow=secrets.ALLOW_LIST):
    """Every window's entropy, counted from nothing."""
    out = []
    for n, (kind, _, members, bits) in enumerate(secrets.ENTROPY_CLASSES, len(BASE)):
        for m in re.finditer(f"[{re.escape(members)}]+", text):
            v = m[0]
            if len(v) < secrets.WINDOW or not re.search("[0-9]", v) or not re.search("[A-Za-z]", v) or any(re.search(p, v) for p in allow) or (kind != "entropy_hex" and re.fullmatch("[0-9A-Fa-f]+", v)):
                continue
            hot = []
            for i in range(len(v) - secrets.WINDOW + 1):
                share = [c / secrets.WINDOW for c in Counter(v[i : i + secrets.WINDOW]).values()]
                if -sum(s * math.log2(s) for s in share) >= bits - 1e-9:
                    hot.append(i)
            if hot:
                a, b = m.start() + hot[0], m.start() + hot[-1] + secrets.WINDOW
                if not any(s <= a and b <= e for s, _, e, _ in base_spans(text)):
                    out.append((a, n, b, kind))
    return out


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def test_op1_by_brute_force(spark, texts):
    got = queries.op1_secret_scans(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest() and r.spans == listed(base + brute_entropy(texts[r.doc_id]))


def test_op1_entropy_by_brute_force(spark):
    """Random strings of each class beside quiet text, base secrets and what the allow-list knows."""
    rng = np.random.default_rng(8)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = []
    for i in range(120):
        _, _, members, _ = secrets.ENTROPY_CLASSES[i % 2]
        parts = ["é the key is", draw(members, int(rng.integers(20, 70))), "a1" * 20, draw("ab12", 40) + draw(members, 40) + draw("ab12", 30), "and example" + draw(members, 30)]
        parts += ["token = " + draw(members, 30), "0123456789" + draw(members, 20), draw("0123456789", 30), draw("abcdef", 30)]
        rows.append((i, " ".join(rng.permutation(parts))))
    got = secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = 0
    for r in got:
        extra = brute_entropy(rows[r.doc_id][1])
        added += len(extra)
        assert r.spans == listed(base_spans(rows[r.doc_id][1]) + extra)
    assert added > 100


def brute_targets(sizes):
    """(source -> target), by sharing out and capping until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_op4_takes_what_the_targets_say(spark, texts):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    got = queries.op4_mix_sources(spark, SF).collect()
    sizes = Counter()
    for i, t in texts.items():
        sizes[source[i]] += len(re.findall(r"[^\x20\x09-\x0d]+", t))
    targets = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0d]+", texts[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - targets[source[r.doc_id]]) < 1e-6 * r.target
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(texts) and all(abs(taken[s] - t) <= 0.01 * t for s, t in targets.items())


def test_op4_small_sources(spark):
    """Sources of a few words among large ones: none is taken beyond three times, and the sum stays near all words."""
    rows = [(i, "w " * (40 + i % 7), "big") for i in range(400)] + [(1000, "a b c d e", "a"), (1001, "one two three", "tiny"), (1002, "x", None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r.doc_id: r for r in got}
    assert all(r.taken <= 3 * r["size"] for r in got) and [by[i].target for i in (1000, 1001, 1002)] == [15.0, 9.0, 3.0]
    assert all(abs(by[i].taken - by[i].target) <= mixing.BLOCK for i in (1000, 1001, 1002))
    big = [r for r in got if r.doc_id < 1000]
    assert abs(sum(r.taken for r in big) - big[0].target) <= 3 * mixing.BLOCK


def test_op6_bytes_law_and_pruning(spark, texts, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = queries.op6_shard_by_curve(spark, SF)
    got = placed.collect()
    size = {i: len(t.encode()) + 16 for i, t in texts.items()}
    shards = {n: [r for r in got if r.shard == n] for n in range(sharding.SHARDS)}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for n, rows in shards.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows))), n
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], zlib.crc32(texts[r.doc_id].encode()), "bytes", None) for r in got)
    total = [sum(r["size"] for r in rows) for rows in shards.values()]
    assert max(total) - min(total) <= 2 * max(size.values())
    # files: a filter on a dimension leaves most of them unread
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(texts)
    for column in ("source", "lang"):
        rows = {r[0]: r[1] for r in docs.groupBy(column).count().collect()}
        files = {r[0]: r[1] for r in back.groupBy(column).agg(F.countDistinct("shard")).collect()}
        assert all(files[v] <= sharding.SHARDS / 2 for v in rows if rows[v] < 0.2 * len(texts)), column


def test_op7_base_by_brute_force(spark, texts):
    base = {tuple(p.split()): label for p, label in licenses.BASE_PHRASES}
    for r in queries.op7_license_scans(spark, SF).collect():
        words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        at = sorted((i, label) for p, label in base.items() for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op7_one_label_a_version_and_no_bare_words(spark):
    want = {
        "lgpl 2.1": "lgpl-2.1", "mpl 1.1": "mpl-1.1", "cc by 2.5": "cc-by,cc-by-2.5", "eupl 1.2": "eupl-1.2", "GPLv3": "gpl-3.0", "under the LGPLv2.1": "lgpl-2.1", "gpl 2 or later": "gpl-2.0",
        "Apache License, Version 2.0, January 2004": "apache,apache-2.0", "PHP License 3.01": "php-3.01", "wir gehen mit dem Hund": "", "published by MIT Press": "", "the apache tribe": "", "python 3.0 and php": "",
        "released under MIT": "mit", "the artistic and the bsd": "", "BSD 3-clause license": "bsd-3",
    }
    got = {r.doc_id: r.labels for r in licenses.license_report(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())


def test_op7_many_detections_in_one_text():
    words = (b"mit license " * 20000).split()
    assert len(licenses.detect(words)) == 20000


def test_op8_by_brute_force(spark, texts):
    got = queries.op8_media_columns(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.pack(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert payload in stored and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_op8_each_track_has_its_own_tables(spark):
    """Two tracks, the first without a table of keyframes: all of its samples are keyframes, and only an eighth of the second's."""
    whole = media.pack(bytes(range(64)) * 160)
    (at, end), = [(a, b) for path, a, b in media.walk(whole) if path == (b"moov", b"trak")]
    first = whole[at:end].replace(b"stss", b"free")
    moov = media._box(b"moov", media._box(b"trak", first), media._box(b"trak", whole[at:end]))
    both = media._box(b"ftyp", b"isom\0\0\0\1isom") + moov
    rows = media.media_columns(spark.createDataFrame([(1, bytearray(both)), (2, None), (3, bytearray(whole[:90]))], "id long, media binary"), "id", "media").collect()
    assert sorted((r.media_id, r.track, len(r.keyframes or [])) for r in rows if r.media_id == 1) == [(1, 0, 160), (1, 1, 20)]
    assert [(r.track, r.codec) for r in rows if r.media_id != 1] == [(None, None)] * 2


def brute_top(rows, k=20):
    """Exact integers of Python; rows that share an id are all candidates, the least vector is the query."""
    whole = [(i, [math.floor(64 * x) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v in rows]
    out = {}
    for q in sorted({i for i, _ in whole if i % 20 == 0}):
        vec = min((v for i, v in rows if i == q))
        query = [math.floor(64 * x) if abs(x) < 1e300 else int(x) * 64 for x in vec]
        score = lambda v: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(query, v, strict=False))))
        out[q] = sorted((-score(v), i) for i, v in whole if i != q)[:k]
    return out


def test_op3_large_components_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(400)]
    rows += [(500, [4e7, 0.0, 1.0, 0.0, 0.0]), (501, [1.0, 1.0, 0.0, 0.0, 0.0]), (520, [1e30, 1.0, -1.0, 0.0, 0.0]), (540, [-1e17, 3.0, 2.0, 1.0, 0.0]), (502, [1e200, 0.0, 0.0, 0.0, 0.0])]
    rows += [(20, rng.normal(size=5).tolist()), (7, rows[7][1]), (7, rng.normal(size=5).tolist()), (503, [0.25]), (504, [])]
    for shard_rows, query_rows in ((100, 4), (10**6, 10**6)):
        got = {}
        for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=shard_rows, query_rows=query_rows).collect():
            got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
        assert {q: [h[1:] for h in sorted(hits)] for q, hits in got.items()} == brute_top(rows)


def odd_tables(spark):
    """A table of documents with columns of clashing names, very long and repeated rows, nulls everywhere, and an empty one."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, shard int, secrets string, ids string, key string, component long, score double, `rank` int, id long, __text string, __hash long, labels string"
    names = [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]
    row = lambda i, t: tuple({"doc_id": i, "text": t, "lang": "en", "source": "s"}.get(n) for n in names)
    rows = [row(1, None), row(2, ""), row(3, "a"), row(3, "a"), row(None, "gpl 2"), row(None, None), row(4, "lorem ipsum " * 40000), row(5, "x" * 300000), tuple([None] * len(names))]
    return spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)


@pytest.mark.parametrize("name", ["secrets", "near", "mixing", "sharding", "licenses", "media", "bpe", "langid"])
def test_odd_tables(spark, name):
    report = {
        "secrets": secrets.secret_report, "near": near_dedup.near_duplicates, "mixing": mixing.mix_sources, "sharding": sharding.shard_by_curve, "licenses": licenses.license_report, "media": media.media_report,
        "bpe": lambda d: bpe.bpe_report(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), "langid": langid.language_report,
    }[name]
    odd, none = odd_tables(spark)
    got = report(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert len({str(r) for r in got if r.doc_id == 3}) <= (1 if name not in ("mixing", "sharding") else 2)
    assert report(none).count() == 0 and report(none).columns == report(odd).columns


def test_odd_conversations_and_vectors(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, formatted string, t string"
    long = "word [INST] " * 50000
    rows = [(1, 0, "user", long, None, None, None), (1, 1, "assistant", long, "x", "y", "z"), (1, 1, "assistant", long, "x", "y", "z"), (2, None, None, None, None, None, None), (None, 0, "assistant", "hi", None, None, None)]
    got = {r.conv_id: r for r in chat.chat_report(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars, got[None].loss_chars) == (3, 2 * len(long), 0, 2)
    assert got[1].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest() and chat.chat_report(spark.createDataFrame([], schema)).count() == 0
    schema = "vec_id long, embedding array<float>, id long, e string, `rank` int, score long, shard int, block int"
    rows = [(i, [1.0] * 2000, None, "x", 1, 2, 3, 4) for i in (20, 21)] + [(22, None, *[None] * 6), (None, [1.0], *[None] * 6), (23, [None], *[None] * 6), (24, [float("inf")], *[None] * 6)]
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, schema)).collect()] == [(20, 1, 21, 2000 * 4096)]
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0


def test_staged_tables_go_when_they_are_done_with(spark, tmp_path, monkeypatch):
    class Cluster:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Cluster())
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(i, f"alpha beta gamma delta epsilon zeta eta theta iota kappa w{i % 3} lambda mu nu") for i in range(12)], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs, width=2).count() == 12
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == ["grouped", "groups", "signatures"]  # what the result reads
    one = common.staged(docs, "one")
    common.discard(one, docs)
    assert not list(tmp_path.glob("tremolite-one-*"))


@pytest.mark.parametrize("size", [2, 3, 5, 8, 9, 10, 12, 20, 40])
def test_recall_at_the_threshold(size):
    """Pairs of ``size`` and more shingles at the least similarity of 0.8 and more: found by a band, or exactly if small."""
    rng = np.random.default_rng(size)
    other = next(n for n in range(size, 0, -1) if 100 * n < 80 * size) + 1  # the smaller set, all of it shared
    lost = 0
    pairs = 1000
    sets = []
    for _ in range(pairs):
        x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * 2 + 1)
        sets += [x, np.sort(rng.permutation(x)[:other])]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    keys = near_dedup.band_keys(near_dedup.registers_of(np.concatenate(sets), at))
    for p in range(pairs):
        larger, smaller = sets[2 * p], sets[2 * p + 1]
        exact = near_dedup._less_one(near_dedup._mix(larger ^ near_dedup._K3), 80) or []
        mixed = near_dedup._mix(smaller ^ near_dedup._K3)
        whole = near_dedup._mix(mixed.sum(dtype=np.uint64, keepdims=True) ^ (np.array([len(smaller)], np.uint64) * near_dedup._K2)).view(np.int64)[0]
        lost += not (keys[2 * p] == keys[2 * p + 1]).any() and not (len(smaller) == len(larger) or whole in exact)
    assert lost == 0


def brute_groups(texts, width, threshold):
    """The least doc_id of each document's group, by comparing all sets of like sizes."""
    ids, sets = {}, {}
    for d, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        shingles = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
        sets[d] = np.unique([ids.setdefault(s, len(ids)) for s in shingles])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by_size = sorted((d for d in sets if len(sets[d])), key=lambda d: len(sets[d]))
    for n, d in enumerate(by_size):
        for o in by_size[n + 1 :]:
            if 100 * len(sets[d]) < threshold * len(sets[o]):
                break
            both = len(np.intersect1d(sets[d], sets[o], assume_unique=True))
            if 100 * both >= threshold * (len(sets[d]) + len(sets[o]) - both):
                a, b = sorted((find(d), find(o)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_of_the_whole_table(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_minhash_near_dedup(spark, SF).collect()}
    assert got == brute_groups(texts, 2, 80)


def test_words_made_to_collide_are_told_apart(spark):
    """Words that every polynomial modulo 2 ** 64 gives one hash: each step appends the word with a and b swapped."""
    word, swap = "a", str.maketrans("ab", "ba")
    for _ in range(12):
        word += word.translate(swap)
    rows = [(1, word), (2, word.translate(swap)), (3, word[:2048]), (4, word[:2048].translate(swap))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def full_top(ids, vectors, queries, k):
    """(query, rank, vec_id, score) from all scores."""
    w = np.floor(vectors.astype(float) * 64).astype(np.int64)
    out = []
    for q in queries:
        scores = w @ w[q]
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-scores[i], ids[i]))[:k]
        out += [(ids[q], n, ids[i], int(scores[i])) for n, i in enumerate(order, 1)]
    return sorted(out)


@pytest.fixture
def maxscore_calls(monkeypatch):
    calls = []
    real = topk.maxscore

    def counted(queries, postings, lo, hi, thresholds):
        calls.append(postings.shape[1])
        return real(queries, postings, lo, hi, thresholds)

    monkeypatch.setattr(topk, "maxscore", counted)
    return calls


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_maxscore_runs_on_every_given_table(spark, maxscore_calls, sf):
    """What a task of the query does with the table: all rows but the first few hundred of a shard are searched by bounds."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    table = lambda some: pa.table({"id": pa.array([ids[i] for i in some]), "e": pa.array([vectors[i].tolist() for i in some], pa.list_(pa.float64()))})
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    got = topk._search(20)(table(asked), table(range(len(ids)))).to_pylist()
    assert sum(maxscore_calls) == len(ids) - topk.FIRST_ROWS > 0
    ranked = sorted((r["query_id"], -r["score"], r["vec_id"]) for r in got)
    assert [(q, v, -s) for q, s, v in ranked] == [(q, v, s) for q, _, v, s in full_top(ids, vectors, asked, 20)]


@pytest.mark.parametrize("kind", ["skewed", "equal", "few"])
def test_maxscore_on_several_pieces(maxscore_calls, monkeypatch, kind):
    monkeypatch.setattr(topk, "PIECE_ROWS", 100)
    monkeypatch.setattr(topk, "FIRST_ROWS", 30)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(630, 24)) * (2.0 ** -np.arange(24) if kind == "skewed" else 1)
    v = np.round(v) if kind == "equal" else v[:35] if kind == "few" else v
    ids = rng.permutation(10_000)[: len(v)].tolist()
    shard = topk.Shard(np.array(ids), np.floor(v * 64))
    asked = list(range(0, len(v), 7))
    query, vec, score = shard.best(np.array([ids[q] for q in asked]), np.floor(v[asked] * 64), 20)
    ranked = sorted((ids[asked[q]], -s, i) for q, s, i in zip(query.tolist(), score.tolist(), vec.tolist(), strict=True))
    assert [(q, i, -s) for q, s, i in ranked] == [(q, i, s) for q, _, i, s in full_top(ids, v, asked, 20)]
    assert sum(maxscore_calls) == len(v) - 30


@pytest.mark.parametrize(("text", "labels"), [
    ("2-clause BSD", {"bsd-2"}), ("the 3-clause BSD license", {"bsd-3"}), ("BSD-3-Clause license", {"bsd-3"}), ("MIT-licensed", {"mit"}), ("MIT licensed software", {"mit"}),
    ("version 2 of the GNU General Public License", {"gpl-2.0"}), ("version 2.1 of the GNU Lesser General Public License", {"lgpl-2.1"}), ("GPLv2 or later", {"gpl-2.0"}),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", {"gpl-2.0", "gpl"}),
    ("dual licensed under Apache-2.0 OR MIT", {"apache-2.0", "mit"}), ("MIT OR Apache-2.0", {"mit", "apache-2.0"}),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND', {"warranty-disclaimer"}), ("used under mit der Hand", set()), ("mit und ohne", set()), ("licensed under MIT", {"mit"}),
])
def test_usual_wordings(text, labels):
    found = licenses.detect(text.lower().encode().translate(licenses._FOLD).split())
    assert {d.label for d in found} == labels


def test_hostile_media_files(spark):
    """Boxes nested without end, and counts that no file could hold."""
    nested = b""
    for _ in range(3000):
        nested = media._box(b"moov", nested)
    good = media.pack(bytes(64 * 40))
    at = good.index(b"stsz") + 8
    huge = good[:at] + (1).to_bytes(4, "big") + (0xFFFFFFFF).to_bytes(4, "big") + good[at + 8 :]
    at = good.index(b"stsc") + 12
    wide = good[:at] + (1).to_bytes(4, "big") + (0xFFFFFFFF).to_bytes(4, "big") + good[at + 8 :]
    far = good[:at] + (0xFFFFFFF0).to_bytes(4, "big") + good[at + 4 :]
    files = [(1, nested), (2, good), (3, huge), (4, wide), (5, far), (6, None), (7, b"")]
    got = {r.media_id: r.n_samples for r in media.media_columns(spark.createDataFrame([(n, None if f is None else bytearray(f)) for n, f in files], "id long, media binary"), "id", "media").collect()}
    assert got[1] is None and got[2] == 40 and got[3] is None and got.keys() == set(range(1, 8))


def test_places_of_categories_keep_their_order(spark):
    rows = [(i, "t", f"s{i % 90:02}" if i % 11 else None, "en") for i in range(900)] + [(-1, "t", "s00", None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = df.select("source", sharding.places(df, "source").alias("p"), sharding.places(df, "lang").alias("l")).distinct().collect()
    placed = sorted((r.source, r.p) for r in got if r.source)
    assert [p for _, p in placed] == sorted(p for _, p in placed) and len({p for _, p in placed}) == 63 and {r.p for r in got if r.source is None} == {0} and {r.l for r in got} == {0, 63}
    few = df.filter("source < 's40'")
    assert len({r.p for r in few.select(sharding.places(few, "source").alias("p")).collect()}) == few.select("source").distinct().count()


def test_a_row_repeated_often_is_no_hot_window(spark):
    rows = spark.range(40_000).selectExpr("7L AS doc_id", "'same text' AS text", "'a' AS source", "'en' AS lang")
    got = sharding.shard_by_curve(rows, shards=10).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert {(r.n, r.d, r.m) for r in got} == {(4000, 4000, 3999)} and len(got) == 10

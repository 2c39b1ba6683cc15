"""Encoding, packing, secrets, fingerprints and near groups against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from lurescope.llm import arrow_text, bpe_codec, byte_bpe, minhash, packing, secrets, simhash


@pytest.fixture(scope="module")
def full():
    return byte_bpe.tokenizer(byte_bpe.vocabulary_path("byte_bpe_50k.json"))


def by_key(frame):
    out = {}
    for row in frame.collect():
        out.setdefault(row["doc_id"], []).append(row)
    return out


def test_codec_matches_the_tokenizers_library(documents, odd, full):
    rows = by_key(bpe_codec.digests(documents(odd)))
    assert sum(map(len, rows.values())) == len(odd)
    for key, text in odd:
        ids = full.encode(text or "", add_special_tokens=False).ids
        decoded = full.decode(ids, skip_special_tokens=False)
        for row in rows[key]:
            assert row["n_tokens"] == len(ids)
            assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
            assert decoded == (text or "")


def test_codec_of_an_empty_table(documents):
    assert bpe_codec.digests(documents([])).count() == 0


def test_words_join_to_the_text():
    import pyarrow as pa

    texts = ["a  b", " lead", "trail ", "", "tab\t x", "one two,three", "x 　y"]
    words = arrow_text.spaced_words(pa.array(texts))
    vocab = words.vocab.to_pylist()
    joined = ["".join(vocab[c] for c in words.codes[a:b]) for a, b in zip(words.offsets, words.offsets[1:])]
    assert joined == texts


def test_packing_is_gapless_and_whole(documents, odd, full):
    rows = packing.pack(documents(odd), capacity=64).collect()
    ids = {k: full.encode(t or "", add_special_tokens=False).ids + [0] for k, t in odd}
    pieces, bins = {}, {}
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and 0 < r["length"] <= 64
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, own in pieces.items():
        copies = sum(k == key for k, _ in odd)
        assert sum(length for _, _, length in own) == copies * len(ids[key])
        assert all(length == 64 for piece, _, length in own if piece)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(ids[k]) for k, _ in odd)
    assert len(bins) <= -(-total // 64) + 1


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    counts = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 101), 60, False), rng.integers(1, 5000, 60))}
    slots, bins = packing.plan_bins(counts, 100)
    assert {s: sum(hi - lo for l, lo, hi, *_ in slots if l == s) for s in counts} == counts
    used = np.zeros(bins, dtype=int)
    for length, lo, hi, first, each, offset in slots:
        n = (hi - lo) // each
        assert (used[first : first + n] == offset).all()
        used[first : first + n] += each * length
    assert used.max() <= 100
    assert bins <= 1.02 * max(sum(s * n for s, n in counts.items()) / 100, sum(n for s, n in counts.items() if s > 50)) + 1


def test_packing_of_an_empty_table(documents):
    assert packing.pack(documents([])).count() == 0


def test_base_secrets():
    text = 'x password = "abcdef" token:abc AKIA' + "B" * 16 + " AKIASHORT " + "0123456789abcdef" * 2
    found = [(k, text[a:b]) for a, k, b in secrets.base_spans(text)]
    assert found == [(0, 'password = "abcdef'), (1, "AKIA" + "B" * 16), (2, "0123456789abcdef" * 2)]


def test_random_strings_are_found_and_known_ones_left(documents):
    texts = {
        1: "key qX7pL0zR4vTn8KwB3mYh6Jd2 end",
        2: "sha1 da39a3ee5e6b4b0d3255bfef95601890afd80709 end",
        3: "id 123e4567-e89b-12d3-a456-426614174000 end",
        4: "call some_long_identifier_name_2024 or anotherCamelCaseName here",
        5: "thatnreandthionblelyingsh is a made up word",
    }
    rows = {r["doc_id"]: r["secrets"] for r in secrets.find_secrets(documents(list(texts.items()))).collect()}
    kinds = {k: [s["kind"] for s in v] for k, v in rows.items()}
    assert kinds == {1: ["random"], 2: ["hex"], 3: [], 4: [], 5: []}
    assert texts[1][rows[1][0]["start"] : rows[1][0]["end"]] == "qX7pL0zR4vTn8KwB3mYh6Jd2"


def test_random_letters_are_not_words(documents):
    rng = np.random.default_rng(14)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    forms = [(lower, 20, ""), (lower, 40, ""), (upper, 32, ""), (lower, 24, "4711")]
    drawn = [["".join(rng.choice(list(a), n)) + end for _ in range(50)] for a, n, end in forms]
    words = ["CONNECTION_REFUSED_BY_REMOTE_SERVER", "internationalization", "a/b/c/d/e/f/g/h/i/j/k/l", "-" * 30]
    texts = [f"see {w} here" for w in [*sum(drawn, []), *words]]
    found = {r["doc_id"]: len(r["secrets"]) for r in secrets.find_secrets(documents(list(enumerate(texts)))).collect()}
    # About one in fifteen has as many characters per token as words.
    assert sum(found[k] for k in range(200)) >= 170
    assert not any(found[200 + i] for i in range(len(words)))


def test_redaction_keeps_everything_else(documents, odd):
    rows = [*odd, (20, "é token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" ü")]
    frame = documents(rows)
    out = secrets.redact(frame)
    assert out.columns == frame.columns and out.count() == len(rows)
    done = by_key(out)
    assert done[20][0]["text"] == 'é <secret>" ü' and done[20][0]["n_chars"] == len('é <secret>" ü')
    assert done[7][0]["text"] is None and done[11][0]["text"] == odd[6][1]


def brute_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    sums = [sum(xxhash.xxh64_intdigest(r, 42) >> j & 1 for r in runs) for j in range(64)]
    return sum(1 << j for j in range(64) if 2 * sums[j] > len(runs))


def test_fingerprints_and_components(documents, odd):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 20
    rows = [*odd, *((100 + i, base + f"tail{i % 4} " * (i // 4)) for i in range(12))]
    found = simhash.near_groups(documents(rows)).collect()
    assert len(found) == len(rows)
    texts = {}
    for key, text in rows:
        texts[key] = brute_print(text)
    keyed = [k for k, _ in rows if k is not None]
    label = {k: k for k in keyed}
    changed = True
    while changed:
        changed = False
        for a in keyed:
            for b in keyed:
                if bin(texts[a] ^ texts[b]).count("1") <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    for r in found:
        assert int(r["fingerprint"], 16) == texts[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["component_id"] == label[r["doc_id"]]


def test_shards_lose_no_link():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (300, 12, 3), dtype=np.uint64)
    near = (centres[:, None] ^ np.bitwise_or.reduce(flips, axis=2)).ravel()
    points = np.unique(np.concatenate([centres, near, rng.integers(0, 1 << 63, 3000, dtype=np.uint64)]))
    linked = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    want = components_of(len(points), np.argwhere(linked))
    mask = np.uint64(0xFFFFFFFF)
    edges = []
    for half, shift in enumerate((np.uint64(0), np.uint64(32))):
        part = (points >> shift) & mask
        tree = simhash.grow_tree(rng.permutation(part)[:800], 100, 1, half)
        leaf, row = simhash.route(tree, part, 1)
        assert len(np.unique(leaf)) > 4
        for one in np.unique(leaf):
            own = row[leaf == one]
            a, b = simhash.shard_links(points[own], half)
            edges += list(zip(own[a], own[b]))
    a, b = simhash.shard_links(points, 0)
    assert (components_of(len(points), np.array(edges)) == want).all()


def components_of(n, edges):
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, edges[:, 0], label[edges[:, 1]])
        np.minimum.at(new, edges[:, 1], label[edges[:, 0]])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(200)
    edges = [(int(a), int(b)) for a, b in zip(order, order[1:])] + [(1000, 1001), (1001, 1002)]
    found = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r["id"] for r in found}) == 199 + 2
    assert all(r["root"] == (1000 if r["id"] >= 1000 else 0) for r in found)


def test_keep_one(documents, odd):
    frame = documents(odd)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    keys = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert keys == [(False, 7), (False, 10), (False, 12), (False, 13), (False, 14), (True, 0)]


def test_rows_without_an_id_are_linked(documents):
    rng = np.random.default_rng(20)
    words = [f"w{x}" for x in rng.integers(0, 1 << 30, 4000)]
    chain = [" ".join(words)]
    while len(chain) < 3:  # each step is a link, and the ends are none
        words[int(rng.integers(len(words)))] = f"u{len(chain)}x{rng.integers(1 << 30)}"
        own = " ".join(words)
        steps = [bin(brute_print(own) ^ brute_print(t)).count("1") for t in chain]
        if 2 <= steps[-1] <= 3 and (len(steps) == 1 or steps[0] > 3):
            chain.append(own)
    frame = documents([(5, chain[0]), (None, chain[1]), (9, chain[2])])
    assert [r["component_id"] for r in simhash.near_groups(frame).collect()] == [5] * 3
    assert [r["doc_id"] for r in simhash.keep_one(frame).collect()] == [5]
    nameless = documents([(None, chain[0]), (None, chain[1])])
    assert [r["component_id"] for r in simhash.near_groups(nameless).collect()] == [None] * 2
    assert simhash.keep_one(nameless).count() == 1


def jaccard(a, b):
    def runs(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = runs(a), runs(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_edited_pairs(documents, odd):
    base = " ".join(f"w{i % 97}x{i}" for i in range(400))
    rows = [r for r in odd if r[0] != 10] + [(30 + i, base + " more" * i) for i in range(6)] + [(10, odd[4][1])]
    found = {r["doc_id"]: r for r in minhash.edited_pairs(documents(rows, 5)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert len(found) == len(rows)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after, row = text or "", after or "", found[key]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(row["near_edited"] - jaccard(text, edited)) < 0.2
        assert abs(row["near_next"] - jaccard(text, after)) < 0.2
    assert found[10]["fingerprint"] == found[11]["fingerprint"] and found[10]["near_next"] == 1.0


def test_likeness_is_unbiased():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for share in (0.2, 0.8):
        errors = []
        for _ in range(20):
            words = [f"v{x}" for x in rng.integers(0, 1 << 40, 600)]
            a, b = " ".join(words), " ".join(words[: int(600 * share)] + [f"u{i}" for i in range(int(600 * (1 - share)))])
            fa, fb = minhash.fingerprints(pa.array([a, b]))
            errors.append(minhash.likeness(fa, fb) - jaccard(a, b))
        assert abs(np.mean(errors)) < 0.03


def test_single_and_empty_tables(documents):
    row = minhash.edited_pairs(documents([(1, "one two three four five six")])).first()
    assert row["near_next"] == 1.0
    assert minhash.edited_pairs(documents([])).count() == 0
    assert simhash.near_groups(documents([])).count() == 0

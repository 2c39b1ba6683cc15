"""The secret scan's query against a scanner that walks the characters one by one."""

import hashlib
import random
import string

from lurescope.llm import byte_bpe, secrets
from lurescope.llm.queries import op5_secret_scan

VALUE = set(string.ascii_letters + string.digits + "+/_.=-")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def lower(text):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in text)


def run(text, at, allowed):
    end = at
    while end < len(text) and text[end] in allowed:
        end += 1
    return end


def assign_at(text, at):
    """(end, length of the value) of an assignment that begins here, or None."""
    for word in WORDS:
        if lower(text[at : at + len(word)]) != word:
            continue
        i = at + len(word)
        i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
        i = run(text, i, " ")
        if text[i : i + 1] not in (":", "="):
            continue
        i = run(text, i + 1, " ")
        i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
        end = run(text, i, VALUE)
        if end > i:
            return end, end - i
    return None


def scanned(text):
    """(start, kind, end) of the base kinds."""
    found, at = [], 0
    while at < len(text):
        hit = assign_at(text, at)
        if hit and hit[1] >= 6:
            found.append((at, 0, hit[0]))
        at = hit[0] if hit else at + 1
    at = 0
    while at < len(text):
        end = run(text, at + 4, string.ascii_uppercase + string.digits) if text[at : at + 4] == "AKIA" else at
        if end > at + 4 and end - at >= 20:
            found.append((at, 1, end))
        at = end if end > at + 4 else at + 1
    at = 0
    while at < len(text):
        end = run(text, at, "0123456789abcdef")
        if end - at >= 24:
            found.append((at, 2, end))
        at = max(end, at + 1)
    return sorted(found)


def texts(n):
    rng = random.Random(11)
    letters = string.ascii_letters + string.digits + "+/_.=-"
    parts = [
        *WORDS, "PassWord", "API_Key", "tokens", " ", "  ", ":", "=", " = ", '"', "'", "\n", "é", "ſecret", "AKIA", "AKIAAKIA", "_", "-", "the word",
        lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([5, 23, 24, 32, 33, 40, 64]))),
        lambda: "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(rng.randrange(10, 20))),
    ]
    drawn = lambda: (lambda p: p() if callable(p) else p)(rng.choice(parts))
    return ["".join(drawn() for _ in range(rng.randrange(25))) for _ in range(n)]


def test_query_equals_a_scanner(spark, documents, odd, tmp_path):
    rows = [*odd, *((100 + i, t) for i, t in enumerate(texts(600)))]
    documents(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in op5_secret_scan(spark, str(tmp_path)).collect())
    encoder = byte_bpe.tokenizer(byte_bpe.vocabulary_path("byte_bpe_50k.json"))
    kinds, n_random = ("assign", "access", "hex"), 0
    want = {}
    for key, text in rows:
        base = scanned(text or "")
        written = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        counts = [sum(k == i for _, k, _ in base) for i in range(3)]
        want.setdefault(str(key), []).append((*counts, hashlib.sha256(written.encode()).hexdigest(), written, text or ""))
    assert len(got) == len(rows)
    for key, n_assign, n_access, n_hex, digest, spans in got:
        own = [w for w in want[key] if w[:4] == (n_assign, n_access, n_hex, digest)]
        assert own, (key, spans, want[key])
        listed = [s for s in spans.split(",") if s]
        assert ",".join(s for s in listed if not s.startswith("random")) == own[0][4]
        for span in listed:
            kind, start, end = span.split(":")
            if kind == "random":
                piece = own[0][5][int(start) : int(end)]
                n_random += 1
                assert len(piece) >= secrets.MIN_LENGTH
                assert len(piece) <= secrets.MAX_CHARS_PER_TOKEN * len(encoder.encode(piece, add_special_tokens=False).ids)
    assert n_random > 20


def test_empty_table(documents):
    assert secrets.find_secrets(documents([])).count() == 0 and secrets.redact(documents([])).count() == 0

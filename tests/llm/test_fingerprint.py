import hashlib
import random

import regex
import xxhash

from riskloom.llm import fingerprint as W


ALONE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"


def rolling(numbers, k):
    """Each run's hash from that of the run before it."""
    h, out = 0, []
    for i, x in enumerate(numbers):
        if i >= k:
            h = (h - numbers[i - k] * pow(W.BASE, k - 1, W.MODULUS)) % W.MODULUS
        h = (h * W.BASE + x) % W.MODULUS
        if i >= k - 1 or i == len(numbers) - 1:
            out.append(h)
    return out


def prints(text):
    words = regex.findall(rf"(?=[\p{{L}}\p{{M}}\p{{N}}]){ALONE}|(?:(?!{ALONE})[\p{{L}}\p{{M}}\p{{N}}])+", (text or "").lower())
    if not words:
        return []
    signed = [h - (h >> 63 << 64) for h in (xxhash.xxh64_intdigest(w.encode(), 42) for w in words)]
    hashes = rolling([h % W.MODULUS for h in signed], W.GRAM)
    out = {}
    for a in range(max(1, len(hashes) - W.WINDOW + 1)):
        best = min(range(a, min(a + W.WINDOW, len(hashes))), key=lambda i: (hashes[i], -i))
        out[best] = hashes[best]
    return sorted(out.items())


def near(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def written(p):
    return " ".join(f"{h:x}:{i}" for i, h in p)


def test_edited_against_plain_python(spark):
    rng = random.Random(9)
    words = ["a", "bé", "C", "d1", "Ünï", "the", "the", "the"]
    texts = [None, "", "x", "...", "a b", "the " * 60] + [rng.choice(["", " ", "!"]).join(
        rng.choice([" ", ", ", "--"]) + rng.choice(words) for _ in range(rng.randint(0, 70))) for _ in range(80)] + ["\U0001d4b3 b " * 9]
    docs = spark.createDataFrame([(7 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] // 7: r for r in W.edited(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        q = len(text) // 4
        new = text[: len(text) - q] + after[:q]
        p, e = prints(text), prints(new)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (written(p), written(e)), text
        assert abs(r["near_edited"] - near(p, e)) < 1e-9 and abs(r["near_next"] - near(p, prints(after))) < 1e-9


def test_scripts_without_spaces_and_marks(spark):
    """Three quarters of such a text stay, and so do most of its choices; marks part no word."""
    rng = random.Random(3)
    some = lambda low, high, n: "".join(chr(rng.randint(low, high)) for _ in range(n))
    hindi = " ".join(rng.choice(["हिन्दी", "में", "लिखा", "हुआ", "पाठ", "कि", "यह"]) + str(rng.randint(0, 99)) for _ in range(900))
    mixed = "".join(rng.choice(["東京", "tokyo ", "ไทย", "か\u3099", "é", "e\u0301", "。", " "]) for _ in range(150))
    texts = [some(0x4E00, 0x9FA5, 400), some(0x0E01, 0x0E2E, 300), hindi, mixed, some(0x3041, 0x3090, 50) + " abc", "中"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in W.edited(docs).collect()}
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        q = len(text) // 4
        p, e = prints(text), prints(text[: len(text) - q] + after[:q])
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (written(p), written(e)), i
        assert abs(got[i]["near_edited"] - near(p, e)) < 1e-9
    assert got[0]["near_edited"] > 0.5 and got[1]["near_edited"] > 0.5 and got[2]["near_edited"] > 0.5
    assert prints("हिन्दी में लिखा") != prints("ह न द म ल ख")


def test_shared_words_share_a_choice():
    rng = random.Random(1)
    for _ in range(40):
        shared = [str(rng.randint(0, 99)) for _ in range(W.WINDOW + W.GRAM - 1)]
        a, b = ([str(rng.randint(100, 999)) for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert near(prints(" ".join(a + shared)), prints(" ".join(shared + b))) > 0


def test_awkward_rows(spark, awkward, nothing):
    rows = W.edited(awkward).collect()
    assert len(rows) == awkward.count()
    assert W.edited(nothing).count() == W.fingerprints(nothing).count() == 0
    assert {(str(r["doc_id"]), r["fingerprint"]) for r in rows} == {(str(r["doc_id"]), written(prints(r["text"]))) for r in awkward.collect()}
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert W.edited(one).collect()[0]["near_next"] == 1.0

"""Word cutting and encoding of whole texts against the tokenizers library."""

from quillon.llm import bpe

PATH = bpe.public_path("word_bpe_49k.json")


def test_capitals_with_far_lower_case():
    """Capitals of Latin Extended-B whose lower case lies beyond U+024F are letters as well."""
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(PATH), bpe.BpeTokenizer(PATH)
    texts = [f"{x}{chr(c)}{y}" for c in range(0x80, 0x600) for x, y in (("a", "b"), (" ", "1"), ("!", "'s"))]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text)


def test_cutting_in_batches():
    """Plain, long, foreign and special texts mixed in one batch, words over the bounds of cache and merges."""
    import random

    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(PATH), bpe.BpeTokenizer(PATH)
    rng = random.Random(5)
    units = ["'s", "'S", "'re", "'ve", "'ll", "'l", "'d", "''", "!'", "'", "x", "sé", "Ñ", "ł", "ſ", "²", "½", "\x85", "\xa0", "\n", " ", " ", "the", "12", "--", "÷", "ª", "日本", "é", "İ", "<|endoftext|>", "<|"]
    texts = [None, "", " ", *("".join(rng.choice(units[: rng.choice([27, len(units)])]) for _ in range(rng.randint(1, 30))) for _ in range(2000)), "y" * 3000, "z" * 70 + " the " * 50]
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids, ascii(text)


def test_cache_is_bounded(monkeypatch):
    """What was used lately stays, and older words go; ids do not depend on it."""
    monkeypatch.setattr(bpe, "CACHE_WORDS", 200)
    own, whole = bpe.BpeTokenizer(PATH), bpe.BpeTokenizer(PATH)
    texts = [" ".join(["often", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}q" for k in range(n, n + 60))]) for n in range(0, 600, 60)]
    merged = []
    real = own._merge
    monkeypatch.setattr(own, "_merge", lambda words: merged.extend(words) or real(words))
    got = [own.encode_bytes([x])[0] for x in texts]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 200_000)
    assert got == whole.encode_bytes(texts)
    assert merged.count(b"often") == 1 and len(own._cache) + len(own._older) <= 200


def test_no_step_for_each_word():
    """A batch costs less than the regular expression that would find its words one by one."""
    import random
    import re
    import time

    rng = random.Random(2)
    own, words = bpe.BpeTokenizer(PATH), ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    text = " ".join(rng.choice(words) for _ in range(400_000))
    find = re.compile("[a-zªµºß-öø-ÿĀ-ɏ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿĀ-ɏ0-9²³¹¼-¾]+").findall

    def least(f):
        taken = []
        for _ in range(4):
            begun = time.process_time()
            f()
            taken.append(time.process_time() - begun)
        return min(taken)

    assert least(lambda: own.encode_bytes([text])) < 0.8 * least(lambda: find(text))

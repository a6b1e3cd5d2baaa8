import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice(["ba", "ke", "lo", "mi", "tu"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def awkward_texts():
    """Null, empty, blank, short, repeated, non-ASCII and very long texts."""
    rng = random.Random(11)
    base = prose(rng, 300)
    near = base.replace(" the ", " a ", 2)
    return [None, "", " \t\r\n ", "one", "one two", "ONE two", base, base, base.upper(), near, near + " end", "é " * 40, "日本語 テキスト 🤗" * 3, "a\x1cb\x85c\xa0d", prose(rng, 30_000), "x" * 50_000, *(prose(rng, rng.randrange(1, 400)) for _ in range(30))]


def documents(spark, texts, extra=True):
    """Rows of ``documents`` with a null id, a repeated row and columns whose names clash with inner ones."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, 7, "x") for i, t in enumerate(texts)]
    rows += [rows[6], (None, texts[9] if len(texts) > 9 else "x", "en", "s1", 0, 7, "x")] if extra else []
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids long, size string")

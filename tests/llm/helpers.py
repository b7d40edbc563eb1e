"""Small inputs that hold every awkward case, and plain versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, digest string, score double, n_words int, "
        "node string, batch int, y string, held_out int, held string, class_id int, keys string, label int")
LONG = " ".join(f"w{n % 7919}x{n % 31}" for n in range(120_000))


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def docs(spark, rows):
    """(doc_id, text[, source]) rows with further columns whose names the operators use themselves."""
    full = [(i, t, "en", (rest[0] if rest else "a"), len(t) if t is not None else None,
             "d", 0.5, 1, "n", 2, "y", 3, "h", 4, "k", 5) for i, t, *rest in rows]
    return spark.createDataFrame(full, DOCS)


def awkward_rows():
    """Nulls in ids, texts and sources, empty and very long texts, ties, repeated rows."""
    plain = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    return [
        (1, plain), (1, plain), (2, plain), (3, None), (4, ""), (5, "   \n\t "), (6, "word"), (7, LONG), (8, LONG + " end"),
        (None, plain), (None, None), (9, plain + "\n" + "é ß 漢字 " * 30, None), (9, "another text of the same id, a longer line"),
        (10, plain, None), (-5, "a\x00b \x1c c"), (2**62, plain + " more")]


def gibberish(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def seeded(seed):
    return random.Random(seed)

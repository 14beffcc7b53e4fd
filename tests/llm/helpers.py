import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, words string, key string"


def prose(seed, n):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "of", "lor", "ip", "dol", "sit", "am") for b in ("", "en", "ti", "er", "on")]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def texts():
    """Ordinary, edge and repeated texts."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        base, base, " ".join(near), None, "", "   \n\t ", "one two", "one two", prose(2, 4000), prose(3, 60) + "\n" + prose(3, 60),
        "ÉÈ ñ 漢字 " + prose(4, 30), "\n".join(["same line here now"] * 30), "a*** b### c$$$ " * 20, prose(5, 19), prose(6, 20),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [
        (i, t, None if i % 5 == 4 else "en", None if i % 7 == 3 else f"src{i % 3}", len(t or ""), "x", "y", "z", "k")
        for i, t in enumerate(rows)
    ]
    data.append(data[0])  # a repeated row
    return spark.createDataFrame(data, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)

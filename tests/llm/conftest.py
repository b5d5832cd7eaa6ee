import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, keep string, found string, mark string, node string, id string, size long, block long, shard int"


@pytest.fixture(scope="session")
def make(spark):
    """documents of (id, text, source) rows, with columns whose names the operators use inside."""

    def run(rows):
        return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), "k", "f", "m", "n", "i", 1, 2, 3) for i, t, s in rows], ODD)

    return run


def unique(rng, n):
    """Text whose words hardly repeat."""
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (id, text, source) with every awkward case: null and empty texts, null ids, repeated rows, copies, near
    copies, shared passages, long texts, one word over and over, and several alphabets."""
    import random

    rng = random.Random(4)
    passage, base = unique(rng, 60), unique(rng, 150)
    rows = [(k, unique(rng, rng.randint(0, 120)), f"s{k % 4}") for k in range(1, 40)]
    rows += [(100 + k, f"{unique(rng, 30)} {passage}\n{unique(rng, 20)}", "s1") for k in range(5)]
    rows += [(200 + k, base, "s2") for k in (3, 1, 2)]
    for k in range(6):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = "changed"
        rows.append((210 + k, " ".join(words), "s2"))
    rows += [(300, "go " * 400, None), (301, "go " * 380, None), (302, unique(rng, 6000), "s0"), (303, "one two", "s0"), (304, "One  TWO ", "s0"), (305, "世界 🌍 " * 40, "s3"), (306, "世界 🌍 " * 41, "s3")]
    rows += [(400, None, "s0"), (401, "", None), (402, " \n\t ", "s1"), (None, unique(rng, 40), "s1"), (None, None, None), (None, base, "s9")]
    rows += [(500, passage, "s2"), (500, passage, "s2"), (501, passage, None), (501, unique(rng, 50), "s3")]
    return rows

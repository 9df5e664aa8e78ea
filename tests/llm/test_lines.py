"""Line dedup against a plain version."""
import hashlib
from collections import defaultdict

from tests.llm.helpers import documents, empty, odd_and_real, rows
from tidemark.llm import lines

BLANKS = " \t\n\x0b\x0c\r"


def plain_key(line):
    return line.strip(BLANKS).translate({c: c + 32 for c in range(65, 91)})


def plain(texts, min_chars=20, min_docs=3):
    held = defaultdict(set)
    for d, t in texts:
        for x in (t or "").split("\n"):
            held[plain_key(x)].add(-1 if d is None else d)
    many = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for d, t in texts:
        own = -1 if d is None else d
        before = (t or "").split("\n")
        kept = [x for x in before if many.get(plain_key(x), own) == own]
        out.append((d, len(before), len(before) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


LONG = "The same long line of a footer"
MADE = [(10, f"a\n{LONG}\nb"), (11, f"{LONG}\n{LONG}\n"), (12, f"\t{LONG.upper()}  \nown"), (12, f"{LONG}\nother text of the same id"), (None, f"x\n{LONG}"),
        (13, "Éé" * 10 + "\nÉÉ" * 2), (14, "éé" * 10), (15, "Éé" * 10), (16, "Éé" * 10), (17, "\n\n"), (18, "short\nshort"), (19, "short"), (20, "short"),
        (21, "x" * 19), (22, "x" * 19), (23, "x" * 19), (24, "y" * 20), (25, "y" * 20), (26, " y" + "y" * 19), (26, " y" + "y" * 19), (27, f" {LONG}"), (28, f"{LONG}\r")]


def test_lines(spark):
    texts = odd_and_real() + MADE
    df = documents(spark, texts, clash=["n_lines", "fact", "h1", "key", "drops"])
    assert rows(lines.digest(lines.deduplicate_lines(df))) == plain(texts)
    assert rows(lines.digest(lines.deduplicate_lines(df, min_chars=1, min_docs=2))) == plain(texts, 1, 2)
    assert lines.deduplicate_lines(empty(spark)).count() == 0


def test_a_very_long_text_and_a_line_of_all(spark):
    every = "this line stands in every document"
    texts = [(i, f"{every}\nown line number {i} of the table\n{every}") for i in range(3000)]
    texts.append((5000, "\n".join(f"{every}\nline {i} of a very long text" for i in range(60_000))))
    texts += [(6000 + i, "\n".join(f"line {j} of a very long text" for j in range(0, 60_000, 7))) for i in range(2)]
    assert rows(lines.digest(lines.deduplicate_lines(documents(spark, texts)))) == plain(texts)

"""Odd rows that the tests of this folder share."""

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"shared{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
FILL = " ".join(f"fill{i}" for i in range(80))
OTHER = " ".join(f"other{i}" for i in range(80))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, tokens long, node long, page string"


def odd_rows():
    base = " ".join(f"word{i}" for i in range(200))
    near = base.replace("word77", "changed")
    texts = [
        None, "", " \n\t ", "one", "One", "two words", "two words", base, base, near, near + " tail",
        PASSAGE, f"{FILL} {PASSAGE} after", f"Before x {PASSAGE}\n{OTHER}", "And " * 120, LONG, LONG + " more",
        "«é» naïve — 中文 text line", "a\x1cb 1234 !!", "don't WE'LL it's", "12 34 !?",
    ]
    rows = [(9_000 + i, t, None if i % 3 else "en", "src0" if i % 2 else None) for i, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rows.append((9_007, "another text of the same id", "en", "src1"))
    rows.append((None, "a text without an id", "en", None))
    return [(*r, None, "clash", 1, 2, "p") for r in rows]


def odd_vectors():
    """Rows that take no part, zeros, ties and repeats."""
    one = [0.25, -0.5] * 32
    return [
        (90_000, one, 1), (90_001, one, 1), (90_001, one, 1), (90_003, one, 2), (90_004, [x * 0.8 for x in one], 2),
        (90_005, None, 1), (90_006, one, None), (None, one, 1), (90_008, [None] * 64, 1), (90_009, [float("nan")] * 64, 1),
        (90_010, [float("inf")] * 64, 2), (90_050, [0.0] * 64, 3), (90_051, [0.0] * 64, 4), (90_100, [], 5), (90_101, [2.0], 5),
    ]

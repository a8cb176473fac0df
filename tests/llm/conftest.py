import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Columns beside those of documents, with names that operators use inside.
EXTRA = ("score", "rank", "size", "digest", "rep", "sig", "key", "u", "n", "label", "kept", "media", "n_tokens", "step", "component", "stratum", "p", "target", "taken", "held_out")


def words(rng, n, stock):
    return [rng.choice(stock) for _ in range(n)]


def fixture_rows():
    """Documents with nulls, empty and long texts, exact and near copies, repeated rows and repeated ids."""
    rng = random.Random(1)
    stock = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(400)] for lang, letters in (("en", "etaoinshrdlu"), ("fr", "éèaçuoxqltv"), ("de", "äöüßzkwpfgb"))}
    rows, i = [], 0

    def add(text, lang="en", source="s1", quality=None):
        nonlocal i
        rows.append((i, text, lang, source, quality))
        i += 1

    for k in range(120):
        lang = ("en", "fr", "de")[k % 3]
        text = " ".join(words(rng, rng.choice((30, 80, 200)), stock[lang])).capitalize() + ".\nEnd of it."
        add(text, lang, f"s{k % 5}" if k % 9 else None, 1)
    for k in range(40):
        add(" ".join(f"{w}{m}" for w, m in zip(words(rng, 90, stock["en"]), ["###", "$$$", "!!", "%%%"] * 30)), "en", "junk", 0)
    base = words(rng, 300, stock["en"])
    for k in range(12):
        copy = list(base)
        for at in rng.sample(range(300), k // 2):
            copy[at] = f"edit{k}x{at}"
        add(" ".join(copy), "en", "copies", 1)
    add(" ".join(base).upper(), "en", "copies", 1)
    for text in (None, "", " \n\t ", "one", "one two three", "One  TWO\tthree", "42 !! ??", "日本語のテキスト です。", "é ﬁ <|endoftext|> x", "a b c  d\n\n e", "\x1c\x1d\x85 ퟿", "it's we'll don't"):
        add(text, None if text is None else "en", None)
    add(" ".join(words(rng, 30_000, stock["de"])), "de", "s1")
    add("x" * 60_000, "en", "s2")
    add("same line here\n" * 200, "en", "s3", 0)
    rows.append(rows[5])  # the same row again
    rows.append((None, "no id at all", "en", "s1", None))
    rows.append((None, None, None, None, None))
    return rows


def write(path, rows):
    path.mkdir()
    cols = list(zip(*rows)) if rows else [()] * 5
    documents = {"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()), "lang": pa.array(cols[2], pa.string()), "source": pa.array(cols[3], pa.string()), "n_chars": pa.array([None if x is None else len(x) for x in cols[1]], pa.int64())}
    documents |= {c: pa.array([f"{c}{k % 3}" if k % 2 else None for k in range(len(rows))], pa.string()) for c in EXTRA}
    pq.write_table(pa.table(documents), path / "documents.parquet")
    labelled = [(r[0], r[4]) for r in rows if r[4] is not None]
    labelled += [(None, 1)] * bool(rows) + labelled[:2]
    labels = {"doc_id": pa.array([x[0] for x in labelled], pa.int64()), "quality": pa.array([x[1] for x in labelled], pa.int32()), "toxic": pa.array([0] * len(labelled), pa.int32()), "text": pa.array(["clash"] * len(labelled), pa.string()), "lang": pa.array(["clash"] * len(labelled), pa.string())}
    pq.write_table(pa.table(labels), path / "labels.parquet")
    return str(path)


@pytest.fixture(scope="session")
def rows():
    return fixture_rows()


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory, rows):
    return write(tmp_path_factory.mktemp("docs") / "t", rows)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("none") / "t", [])


def crc_mod(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder

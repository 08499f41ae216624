"""Documents with what real tables hold: nulls, blanks, copies, ties, very long texts, odd characters, clashing columns."""

from __future__ import annotations

import random

import pyarrow.parquet as pq

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, part string, row string, y string, norm string, `b` int"
WORDS = "alpha beta gamma delta Epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def texts() -> list[str | None]:
    shared = passage(1, 60)
    return [
        None, "", " ", "\n\t ", "one", "One", "two words", "two  words", "TWO WORDS", "three little words", passage(2, 34), passage(2, 35), passage(2, 35).upper(),
        f"{passage(3, 20)} {shared} {passage(4, 10)}", f"{shared}\n{passage(5, 50)}", f"{passage(6, 5)}\t{shared}", "same " * 80, "same " * 80, "again and " * 40,
        "ΟΔΥΣΣΕΥΣ Éclair naïve ﬁne ＦＵＬＬ İstanbul 漢字かな交じり文 😀👍🏽 é", "a b c　d\x85e\x1cf​g", "null\x00byte", "<|endoftext|> and <|startoftext|>x<|endoftext|>",
        "it's they'll I'D 12345 3.14 --- !!!   spaces   \n\n\n lines\r\n\r\nend   ", "x" * 3000, passage(7, 5000), "Long " + passage(7, 5000)[5:], passage(8, 300), passage(8, 299) + " changed",
    ]


def rows() -> list[tuple]:
    out = [(i * 3, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "s", None if i % 3 == 0 else len(t or ""), "h", "p", None, "y", "n", 1) for i, t in enumerate(texts())]
    return [*out, out[7], out[16], (None, "no id", *out[1][2:]), (-5, passage(8, 300), *out[1][2:])]


def nasty(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def id_texts(sf_dir: str) -> list[tuple]:
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def collected(df, *names) -> list[tuple]:
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


def ordered(found) -> list[tuple]:
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))

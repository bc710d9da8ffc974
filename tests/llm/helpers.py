"""Small adversarial inputs and brute-force versions of the operators."""

import hashlib
import random

import duckdb

SF = "/root/testdata/sf0.001"
#: Columns whose names clash with those that operators use inside.
CLASH = "key long, fp string, v int, shard string, score string, spans string, id string, th string, n_words string, body string"


def texts():
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdeéß", k=r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(60)
    long_ = prose(6000)
    base = prose(200)
    near = base.split()
    near[50] = "other"
    out = [None, "", " \n\t ", "one", "one two", "ONE two Three", shared, f"{prose(30)} {shared}", f"{shared} {prose(30)}",
           f"{prose(9)}\n{shared}\n{shared}", long_, long_, f"x {long_}", base, " ".join(near), base.upper(), "la " * 120,
           "la " * 121, "漢字 かな 🎉 " * 9, "a" * 5000, "\x1c\x85\xa0 odd\x0bspace\x0c", "<|endoftext|> mark"]
    return out + [prose(r.randint(1, 80)) for _ in range(12)]


def documents(spark):
    """Rows with null and repeated ids, null, empty, long and repeated texts, and clashing columns."""
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    rows += [rows[8], rows[13], (None, "no id"), (None, None), (-5, rows[7][1])]
    data = [(i, t, "en", None, None, 1, "f", 2, "s", "0.5", "[]", "i", "t", "n", "b") for i, t in rows]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
    return rows, spark.createDataFrame(data, schema).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASH}")


def sf_rows(sql):
    return duckdb.sql(sql).fetchall()


def words_of(text):
    return (text or "").encode().split()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]

"""Whole jobs: what once was cut short."""

import re
import unicodedata
from collections import Counter, defaultdict

from arcweave.llm import decontam, jaccard, pii, queries, secrets

DOCS = "doc_id long, text string"


# personal data


def test_every_value_has_a_cue(spark):
    each = {
        pii.EMAIL: ["a@b.co"], pii.ADDRESS: ["1.2.3.4"], pii.SOCIAL: ["123-45-6789"], pii.CARD: ["4111 1111 1111 1111"],
        pii.PHONE: ["+33 6 12 34 56 78", "+49 30 12 34 56", "+44 20 79 46 09 58", "+1 2 34 56", "+1(50)55-26", "(504) 555-2652", "504-555-2652"],
        pii.ACCOUNT: ["GB29 NW1K 6A1B 3C1D 9E26 81", "DE12 AB12 CD34 EF56"], pii.PERSON: ["Mr Li", "Mrs. Ann Lee", "Dr Иван", "Señora Ana"],
    }
    assert "|".join(each[p] and p for p in (pii.EMAIL, pii.ADDRESS, pii.PHONE, pii.SOCIAL, pii.ACCOUNT, pii.CARD, pii.PERSON)) == pii.ANY
    values = [v for p in each for v in each[p]]
    got = {r.doc_id: r for r in pii.replaced(spark.createDataFrame([(i, f"so {v} it is") for i, v in enumerate(values)], DOCS), "key").collect()}
    for i, v in enumerate(values):
        assert got[i].n_found == 1 and v not in got[i].text, v


def test_no_value_is_its_own_surrogate(spark, monkeypatch):
    monkeypatch.setattr(pii, "LONGER", 2)
    odd = ["李明@公司.cn", "김철수@서울.kr", "Mr Արամ Պետրոսյան", "Dr Łł", "Frau Ōō", "Mr Ёё", "Mrs Ήή", "_@-.co", "𠀀@𠀁.cn", "محمد@شركة.com"]
    short = [f"Mr {a}{b}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]  # as many as there are: only longer ones are left
    values = odd + short
    got = {r.doc_id: r for r in pii.replaced(spark.createDataFrame([(i, f"{v} said") for i, v in enumerate(values)], DOCS), "key").collect()}
    new = [got[i].surrogates[0] for i in range(len(values))]
    assert len(set(new)) == len(values) and not set(new) & set(values)
    assert all(got[i].text == f"{s} said" for i, s in enumerate(new))
    assert all(re.fullmatch(pii.EMAIL.replace("\\p{L}\\p{N}", "\\w"), s) for s, v in zip(new, values) if "@" in v)
    for v, s in zip(odd, new):
        moved = [(a, b) for a, b in zip(v, s) if ord(a) > 127]
        assert "_" in v or any(a != b for a, b in moved)
        assert all(unicodedata.category(a) == unicodedata.category(b) for a, b in moved), (v, s)


# secrets


def test_pairs_are_of_all_tokens(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE", 3)
    texts = [f"see mail{i}.example.com/en/2012 and mail{i % 3}.example.org/{'x' * (i % 7)}now" for i in range(60)] + ["token = ABCDEFGH12345678", ""]
    want = defaultdict(Counter)
    for t in texts:
        for _, token in secrets.candidates(t, secrets.base_spans(t)):
            for a, b in secrets.transitions(secrets.symbols(token)):
                want[a][b] += 1
    df = spark.createDataFrame([*enumerate(texts), (None, None)], DOCS)
    assert secrets.learn(df).pairs == want and sum(want["length"].values()) > 100


# copies


def test_keep_one_of_repeated_and_null_ids(spark):
    x, y, z, w = ("".join(f"{c}{i} " for i in range(30)) for c in "xyzw")
    rows = [(1, x), (5, x), (5, y), (9, y), (2, z), (2, z), (None, w), (None, w), (None, w + "more"), (None, z), (7, ""), (7, ""), (8, None)]
    got = jaccard.keep_one(spark.createDataFrame([(i, t, 3) for i, t in rows], DOCS + ", copies int"))
    assert got.columns == ["doc_id", "text", "copies"]
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    (last,) = [t for i, t in kept if i is None]
    assert last in (w, w + "more")
    assert kept == Counter([(1, x), (5, y), (2, z), (None, last), (7, ""), (7, ""), (8, None)])


def same_as_sql(got, sql, **tables):
    """Rows of a query and of its SQL on the same small tables."""
    import duckdb

    con = duckdb.connect()
    for name, rows in tables.items():
        con.execute(f"CREATE TABLE {name} ({'doc_id' if name == 'documents' else 'item_id'} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    found = con.execute(sql)
    names = sorted(c[0] for c in found.description)
    key = lambda row: repr(row)
    want = sorted((tuple(dict(zip([c[0] for c in found.description], row))[n] for n in names) for row in found.fetchall()), key=key)
    assert sorted((tuple(r[n] for n in names) for r in got.select(*names).collect()), key=key) == want


def test_repeated_and_null_rows_as_in_sql(spark):
    x, y = "one two three four five six seven eight nine ten eleven", "a b c d e f g h"
    docs = [(3, x), (3, x), (3, y), (None, x), (None, x), (None, None), (4, None), (4, ""), (5, "zero " + x), (6, y), (6, y), (7, "a b"), (8, "b"), (8, "A B")]
    items = [(1, x), (1, x), (2, "b"), (None, y), (3, None), (4, ""), (5, y + " i j k l")]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    same_as_sql(decontam.contaminated(df, bench), queries.OP4, documents=docs, benchmark=items)
    same_as_sql(jaccard.linked_documents(df), queries.OP3, documents=docs)
    clean = [d for d in docs if d[1] in (None, "", y)]
    assert Counter(map(tuple, decontam.keep_clean(df, bench.where("item_id <> 2 or item_id is null")).collect())) == Counter([*clean, (7, "a b"), (8, "b"), (8, "A B")])


def test_benchmark_in_many_blocks(spark, monkeypatch):
    texts = [f"doc {i} " + " ".join(f"w{(i * 7 + k) % 50}" for k in range(30)) for i in range(40)]
    items = [(i, " ".join(f"w{(i * 3 + k) % 50}" for k in range(14))) for i in range(12)] + [(50, "doc")]
    df, bench = spark.createDataFrame([*enumerate(texts)], DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontam.contaminated(df, bench).collect())
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 2000)
    assert sorted(decontam.contaminated(df, bench).collect()) == want
    same_as_sql(decontam.contaminated(df, bench), queries.OP4, documents=[*enumerate(texts)], benchmark=items)

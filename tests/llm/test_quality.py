"""Operator 1 against brute force and its DuckDB SQL."""

import random
import re

import duckdb
import pytest

from riskweave.llm import quality as Q
from riskweave.llm.registry import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "The river rose in the night, and by morning the lower fields were under water for miles around the town."


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    trios = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(trios) if trios.count(x) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    bad = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), bad


def made():
    rnd = random.Random(4)
    vocab = ["a", "bé", "c#", "d|", "e<", "f", "日本"]
    texts = ["".join(rnd.choice(vocab) + rnd.choice([" ", "\n", "  ", "\t", "\x0b", "\r\n"]) for _ in range(rnd.randint(0, 90)))
             for _ in range(40)]
    return texts + [None, "", "\n\n", " x ", "\n".join([GOOD] * 5), "a b c a b c", GOOD * 30]


def test_counts_match_brute_force(spark):
    rows = [(i, t, "z") for i, t in enumerate(made())] + [(0, made()[0], "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = Q.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, t)
        assert not (r.kept and r.base_failed)
    assert Q.judge(df.limit(0)).count() == 0


def test_hash_meetings_are_told_apart_by_words(spark, monkeypatch):
    """With no hash bits left all windows meet, and with tiny positions all are compared."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made())], "doc_id long, text string")
    monkeypatch.setattr(Q, "_POS", 7)
    got = {r.doc_id: r.n_repeat_words for r in Q.judge(df.where("length(text) < 400")).collect()}
    for i, t in enumerate(made()):
        if i in got:
            assert got[i] == brute(t)[4]


def test_lines_and_verdict(spark):
    clean = "\n".join(" ".join(f"word{i}x{j}" for j in range(20)) + ", and so it went." for i in range(5))
    menu = "\n".join(f"Home | About | Contact | Page {i} | More" for i in range(20))
    notice = "All rights reserved."
    rows = [(1, clean), (2, clean + "\n" + notice), (3, menu + "\n" + clean[:150]), (4, "$$$ &&& *** ||| " * 40),
            (5, "WIN!! NOW!! BIG!! " * 30), (6, "no marks at all " * 30)]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].loss == 0 and got[1].clean_text == clean
    assert got[2].kept and got[2].clean_text == clean and 0 < got[2].loss < 0.1
    assert not any(got[i].kept for i in (3, 4, 5, 6))
    assert got[3].loss > Q.MAX_LOSS


PROSE = {
    "hindi": "नदी रात में चढ़ गई और सुबह तक निचले खेत मीलों तक पानी के नीचे थे।",
    "urdu": "دریا رات کو چڑھ گیا اور صبح تک نیچے کے کھیت میلوں تک پانی کے نیچے تھے۔",
    "arabic": "هل ارتفع النهر في الليل وغمرت المياه الحقول المنخفضة حول المدينة في الصباح؟",
    "full width": "川は 夜の うちに 増水し、 朝までに 町の 周りの 低い 畑は 何マイルも 水の 下に なった！",
    "chinese": "河水 在 夜里 上涨 到 早上 镇子 周围 低处 的 田地 已经 淹没 了。”",
    "armenian": "Գետը գիշերը բարձրացավ, և առավոտյան ցածր դաշտերը ջրի տակ էին։",
    "amharic": "ወንዙ በሌሊት ሞላ እና በማለዳ ዝቅተኛ ማሳዎች በውሃ ስር ነበሩ።",
    "burmese": "မြစ်ရေသည် ညတွင် တက်လာပြီး မနက်တွင် လယ်ကွင်းများ ရေအောက်၌ ရှိသည်။",
    "thai": "แม่น้ำ ขึ้น ใน ตอน กลางคืน และ ใน ตอน เช้า ทุ่งนา อยู่ ใต้ น้ำ",
    "greek": "Ανέβηκε το ποτάμι τη νύχτα και ως το πρωί τα χωράφια ήταν κάτω από το νερό;",
    "home": "Home was a long way off, and the next village lay behind the hill that they had to search for on foot.",
    "copyright": "The copyright of the song passed to the daughter of its writer, who never once spoke of it to anybody.",
    "share": "Share the bread among the children first, said the cook, and then see what is left for the rest of us.",
    "menu": "Contact with the enemy was lost in the fog, and the menu of the evening was a cold one for all the men.",
}


def distinct_lines(line, n=14):
    w = line.split()
    return "\n".join(" ".join([*(f"{x}{i}" for x in w[:-1]), w[-1]]) for i in range(n))


def test_clean_prose_of_any_script_is_kept(spark):
    rows = [(k, distinct_lines(t)) for k, t in PROSE.items()]
    for r in Q.judge(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        assert r.loss == 0 and r.kept, r.doc_id


def test_menus_and_notices_by_shape(spark):
    bad = ["Home | About us | Contact. | Jobs.", "Start » Produkte » Schuhe und Stiefel.", "All rights reserved.", "© 2019 Some Company, Inc.",
           "Read our privacy policy and terms of service, then subscribe to the letter that we send you every week of the year.",
           "Copyright 1999 by the authors of this page and of all the other pages that you can find around here, and so on.",
           "function f(x) { return x; }", "© ООО «Река», все права защищены.", "版权所有。"]
    good = ["He wrote x > y > z on the board, and then, without a word to anyone in the hall that evening, he turned and left the room.",
            "The cookie jar stood on the shelf above the stove, and no child in the house could reach it without a chair.",
            "Braces such as { are rare in prose, but this one stands in a sentence that goes on for a while."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bad + good)], "doc_id int, text string")
    got = {r.doc_id: r.clean_text for r in Q.judge(df).collect()}
    assert [got[i] for i in range(len(bad))] == [""] * len(bad)
    assert [got[len(bad) + i] for i in range(len(good))] == good


def test_sql_agrees_on_made_texts(spark):
    texts = [distinct_lines(t, 4) for t in PROSE.values()] + made() + ["Home | a. | b.\nAll rights reserved.\n{ a }\n© 2020 x y.\nok."]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t in enumerate(texts)])
    rel = con.execute(ORACLE_SQL["op1_quality_rules"])
    cols = [d[0] for d in rel.description]
    out = Q.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(*cols)
    assert sorted(tuple(r) for r in out.collect()) == sorted(rel.fetchall())


def test_labelled_documents(spark):
    """Rows labelled good stay and rows labelled bad go (those that the base rules don't decide)."""
    quality = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = [r for r in QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in quality and not r.base_failed]
    assert len(out) > 200 and all(r.kept == (quality[r.doc_id] == 1) for r in out)


def test_very_long_text(spark):
    text = distinct_lines(PROSE["home"], 60_000) + "\nAll rights reserved."
    r = Q.judge(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r.kept and r.n_words > 1_200_000 and 0 < r.loss < 1e-4


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/{sf}/documents.parquet')")
    rel = con.execute(ORACLE_SQL["op1_quality_rules"])
    cols = [d[0] for d in rel.description]
    want = sorted(rel.fetchall())
    out = QUERIES["op1_quality_rules"](spark, f"/root/testdata/{sf}")
    assert sorted(out.columns) == sorted(cols)
    assert sorted(tuple(r) for r in out.select(*cols).collect()) == want


def test_native_plan(spark, sf_dir):
    plan = QUERIES["op1_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)

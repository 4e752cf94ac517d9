"""Filter audit, fill-in-the-middle and chat formatting: oracles, plain Python versions and odd tables."""

import hashlib
import itertools
import pickle
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry_points
from check import compare
from telesift.llm import audit, chat, middle, template


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_fill_in_middle", "op13_chat_format"])
def test_matches_oracle(spark, con, sf, name):
    ok, note = compare(spark, con, name, sf)
    assert ok, note


# ---- filter audit


def plain_audit(docs, labels):
    """The report by brute force over (doc_id, text, lang) and (doc_id, quality, toxic)."""
    good, toxic = {l[0] for l in labels if l[1] == 1 and l[0] is not None}, {l[0] for l in labels if l[2] == 1 and l[0] is not None}
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        fails.append((lang or "", i, {f for f, x in found.items() if x}))
    out = {}
    removed_by = Counter()
    for part in {p for p, _, _ in fails}:
        rows = [(i, f) for p, i, f in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in rows) - len(gone)
                unique = sum(r[1] == {f} for r in rows)
                removed_by[part, f] += len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), redundant, unique, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                left = kept
    return {(p, o, s): (*v, removed_by[p, o[s - 1]]) for (p, o, s), v in out.items()}


def found_audit(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_brute_force_on_odd_rows(spark, odd):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (5, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as good", "'x' as digest")
    docs = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    got = found_audit(audit.audit(odd, table))
    assert got == plain_audit(docs, labels)
    assert {p for p, _, _ in got} == {"", "en", "de"} and len(got) == 3 * 600


def test_audit_of_a_group_of_copies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(audit, "SHARES", 16)
    monkeypatch.setattr(audit, "BITS", 64)
    docs = [(i, "same text #" if i % 3 else f"other {i}", "en") for i in range(60)] + [(7, "same text #", "de"), (None, "same text #", None), (None, "", None), (None, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    got = found_audit(audit.audit(df, spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")))
    assert got == plain_audit(docs, [(1, 1, 0), (2, 1, 1)])


def test_audit_of_empty_tables(spark, empty, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty, none).count() == 0
    assert sum(r.kept + r.removed for r in audit.audit(odd, none).where("filter_order = 'ABCDE' and step = 1").collect()) == odd.count()


# ---- fill in the middle


def plain_middle(i, text):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    x = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if t == "" or any(m in t for m in ("<P>", "<S>", "<M>")):
        return len(u), "plain", None, None, t
    if h[3] % 100 < 50:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_middle_equals_plain_version_and_comes_back(spark, odd, empty):
    extra = [(i, t) for i, t in enumerate(["<P>", "a<S>b\nc", "x\n<M", ">y", "<\n<\nP>\n", "\n\n\n", "é\n日本\n\U0001f600 end", "a\r\nb\r\n", None], 1000)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    df = docs.selectExpr("*", "'c' as output", "1 as form", "2 as n", "'t' as restored")
    got = middle.from_middle(middle.to_middle(df)).collect()
    want = Counter((r.doc_id, *plain_middle(r.doc_id, r.text), r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.from_middle(middle.to_middle(empty)).count() == 0


def test_middle_rates(spark, odd):
    assert {r.form for r in middle.to_middle(odd, middle.Middle(rate=0)).collect()} == {"plain"}
    assert {r.form for r in middle.to_middle(odd, middle.Middle(spm=0)).collect()} == {"plain", "psm"}


@pytest.mark.parametrize("window", [1, 7, 1 << 20])
def test_scatter_and_gather_in_windows(monkeypatch, window):
    monkeypatch.setattr(middle, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(100):
        texts = ["".join(rng.choice(["a", "é", "\n", "<", "P>", "S>", "<M", "日", "x\n"]) for _ in range(rng.choice([0, 0, 1, 2, 3, 9, 40]))) for _ in range(rng.randint(0, 9))]
        h = np.array([[rng.getrandbits(32) for _ in texts] for _ in range(4)], np.int64).reshape(4, -1)
        data, offsets = middle.buffer_of(pa.array(texts, pa.string()))
        n, form, prefix, mid, out, at = middle.transformed(data, offsets, h, 100, 50)
        outputs = [bytes(out[a:b]).decode() for a, b in itertools.pairwise(at)]
        for i, t in enumerate(texts):
            u = re.findall(r"[^\n]*\n|[^\n]+", t)
            a, b = sorted((int(h[0][i]) % (len(u) + 1), int(h[1][i]) % (len(u) + 1)))
            pre, m, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
            want = t if form[i] == "plain" else f"<S>{suf}<P>{pre}<M>{m}" if form[i] == "spm" else f"<P>{pre}<S>{suf}<M>{m}"
            assert outputs[i] == want and n[i] == len(u)
            assert (form[i] == "plain") == (not t or any(x in t for x in ("<P>", "<S>", "<M>")))
        back, where = middle.rebuilt(out, at, np.array(list(form), dtype=object))
        assert [bytes(back[a:b]).decode() for a, b in itertools.pairwise(where)] == texts


def test_a_damaged_output_is_an_error():
    data, offsets = middle.buffer_of(pa.array(["<P>abc<M>d"], pa.string()))
    with pytest.raises(ValueError, match="marks"):
        middle.rebuilt(data, offsets, np.array(["psm"], dtype=object))


# ---- template language


def rendered(source, messages=(), parameters=None):
    return template.Template(source, parameters).conversation(list(messages))


M = [{"role": "user", "text": "Hi"}, {"role": "assistant", "text": "Yo"}, {"role": "user", "text": None}]


def test_language():
    src = """{# remark #}{{ 'a' ~ (1 + 2) }}{% for m in messages -%}
      {{ loop.index }}/{{ loop.length }}{% if loop.first %}!{% elif loop.last %}.{% else %}-{% endif %}{% set t = m.text|default("none") %}{{ t|upper }}
    {%- for x in [1, 'b'] %}{{ x }}{% endfor %};{% endfor %}{% if messages|length > 2 and not (1 in [2]) %}end{% endif %}{{ "q" if 3 % 2 == 1 else "r" }}"""
    assert rendered(src, M).text == "a3" + "1/3!HI1b;" + "2/3-YO1b;" + "3/3.NONE1b;" + "endq"


def test_constants_are_folded():
    src = "{{ bos ~ 'x' }}{% if debug %}no{% else %}y{{ 1 + 2 }}{% endif %}z{% for m in messages %}{{ sep|upper }}-{{ m.text }}{% if not debug %}!{% endif %}{% endfor %}"
    t = template.Template(src, {"bos": "<s>", "debug": False, "sep": "ab"})
    assert t.tree[0] == template.Emit(template.Const("<s>xy3z")) and len(t.tree) == 2
    assert t.tree[1].body == (template.Emit(template.Const("AB-")), template.Emit(template.Apply("get", (template.Name("m"), template.Const("text")))), template.Emit(template.Const("!")))
    shadowed = "{% set a = 1 %}{% for m in messages %}{% set b = m.text %}{% if m.role == 'user' %}{% set p = b %}{% endif %}{{ p }}{% endfor %}{{ p }}"
    assert template.Template(shadowed, {"p": "k"}).conversation(M[:2]).text == "Hikk"


@pytest.mark.parametrize("source", [
    "{% for m in messages %}{{ m.text", "{% for m in messages %}", "{% if 1 %}{% for m in messages %}{% endfor %}", "{{ nobody }}{% for m in messages %}{% endfor %}", "no loop",
    "{% for m in messages %}{{ m.text.__class__.x }}{% endfor %}", "{% for m in messages %}{{ m.text|system }}{% endfor %}", "{% for m in messages %}{{ messages[0].text }}{% endfor %}",
    "{% for m in messages %}{% import os %}{% endfor %}", "{% for m in messages %}{{ f(m) }}{% endfor %}", "{% for m in messages %}{% for c in m.text %}{% endfor %}{% endfor %}",
    "{% for m in messages %}{{ 'a' * 9 }}{% endfor %}", "{% for m in messages %}{{ m }}{% endfor %}", "{% for m in messages %}{% endfor %}{{ m.text }}",
])
def test_sandbox_and_errors(source):
    with pytest.raises(template.TemplateError):
        template.Template(source).conversation(M[:2])


def test_generation_spans_and_pickling():
    t = template.Template("<<{% for m in messages %}{% generation %}{{ m.text }}{% generation %}+{% endgeneration %}{% endgeneration %}|{% endfor %}{{ messages|length }}>>")
    out = pickle.loads(pickle.dumps(t)).conversation(M)
    assert out.text == "<<Hi+|Yo+|+|3>>" and [out.text[a:b] for a, b in out.spans] == ["Hi+", "Yo+", "+"]
    assert "".join(t.turn(m, i, 3).text for i, m in enumerate(M)) == out.text


# ---- chat formatting

CONV = "conv_id long, turn long, role string, text string, piece string, spans int, n_turns string"
TOKENS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "s>", "INST]", "/", " ", "x", "é", "\n", "\U0001f600"]


def test_any_text_comes_back():
    rng, t, unescape = random.Random(1), chat.instruct(), chat.CONTROLS.unescaper()
    for _ in range(1500):
        def text(n):
            return "".join(rng.choice(TOKENS) for _ in range(rng.randint(0, n)))

        messages = [{"role": rng.choice(["user", "assistant", "system", text(4)]), "text": text(9)} for _ in range(rng.randint(0, 5))]
        out, reader, got, step = t.conversation(messages), chat.Reader(), [], rng.randint(1, 7)
        for i in range(0, len(out.text), step):
            got += reader.feed(out.text[i : i + step])
        reader.done()
        assert got == [(m["role"], m["text"]) for m in messages]
        assert [unescape(out.text[a:b]) for a, b in out.spans] == [m["text"] for m in messages if m["role"] == "assistant" and m["text"]]
        assert out.text.count("</s>") == len(messages)


def test_controls_that_overlap_are_refused():
    for strings in (("<a>", "><"), ("ab", "abc"), ("x",), ("a\\b",)):
        with pytest.raises(ValueError):
            chat.Controls(strings)


def conversations():
    rng = random.Random(3)
    rows = [(c, k, rng.choice(["user", "assistant"]), "".join(rng.choice(TOKENS) for _ in range(rng.randint(0, 30)))) for c in range(12) for k in range(rng.randint(1, 9))]
    rows += [(100, k, "assistant" if k % 2 else "user", f"turn {k} </s>") for k in range(700)]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", None), (5, None, None, None), (6, 0, "tool", "same"), (6, 0, "tool", "same"), (200, 0, "assistant", "long [INST] " * 20_000)]
    rng.shuffle(rows)
    return [(*r, "p", 1, "q") for r in rows]


def expected(rows, order):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for c, rs in by.items():
        rs = sorted(rs, key=lambda r: (r[1] is None, r[1] or 0, order[r[2] or "", r[3] or ""]))
        learned = "".join(r[3] or "" for r in rs if r[2] == "assistant")
        text = chat.instruct().conversation([{"role": r[2] or "", "text": r[3] or ""} for r in rs]).text
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs)
        out[c] = (len(rs), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text))
    return out


@pytest.mark.parametrize("most_turns", [1024, 5])
def test_conversations_of_any_length(spark, monkeypatch, most_turns):
    monkeypatch.setattr(chat, "MOST_TURNS", most_turns)
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).repartition(4)
    order = {(r.role, r.text): r.h for r in df.selectExpr("coalesce(role, '') as role", "coalesce(text, '') as text").selectExpr("*", "xxhash64(role, text) as h").collect()}
    got = {r.conv_id: tuple(r)[1:] for r in chat.formatted_and_read(df).collect()}
    assert got == expected(rows, order)
    pieces = chat.format_turns(df)
    assert {r.conv_id: tuple(r)[1:] for r in chat.read_back(pieces.repartition(3)).collect()} == got


def test_no_conversations(spark):
    assert chat.formatted_and_read(spark.createDataFrame([], CONV)).count() == 0

"""Token counts, quality rules, packing and chat formats against plain Python."""

import os
import random
import subprocess
import sys
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recollect.llm import packing, quality, token_files, wordpieces
from recollect.llm.chat_format import TEMPLATE, format_conversations, read_back
from recollect.llm.chat_template import TemplateError, compile_template, escape, fold, parse, unescape
from recollect.llm.wordpieces import bpe_table

RANKS, PIECES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"))
MODEL = Tokenizer.from_file(WORDS)
TEXTS = [None, "", " \n\t ", "Hello, world.\nHello again!", "don't stop, it's 1234 units.", "Ünïcödé ß ﬁ İstanbul \u00a0x\u2003y", "<|endoftext|> and <|STARTOFTEXT|>", "漢字かな交じり文 🤦🏼‍♂️", "a" * 5000, "word " * 9000, "x.) \"y\", z!? end."]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i * 3, t, "zz") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_token_counts_match_direct_encoding(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs(spark, TEXTS * 3).repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    encoding = token_files.rank_encoding(RANKS, public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], len(encoding.encode_ordinary(r["text"] or ""))) for r in table.collect())
    for block in (7, 1 << 20):
        got = token_files.token_counts(table, RANKS, public_tokenizers.PATTERN, 50256, block=block)
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    empty = spark.read.schema("doc_id long, text string").parquet(path).where("false")
    assert token_files.token_counts(empty, RANKS, public_tokenizers.PATTERN, 50256).collect() == []


def test_token_files_of_few_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PER_FILE", 4)
    path = str(tmp_path / "docs")
    docs(spark, TEXTS * 3).repartition(2).write.parquet(path)
    table = spark.read.parquet(path)
    encoding = token_files.rank_encoding(RANKS, public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], len(encoding.encode_ordinary(r["text"] or ""))) for r in table.collect())
    got = token_files.token_counts(table, RANKS, public_tokenizers.PATTERN, 50256, block=50).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert max(r["ordinal"] for r in got) == 3


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_separator_scan(spark, tmp_path, block):
    rng = random.Random(block)
    want = set()
    for f in range(4):
        ids = [0 if rng.random() < 0.2 else rng.randrange(1, 9) for _ in range(rng.choice([0, 1, 40, 61]))]
        (tmp_path / f"part-{f}").write_bytes(np.array(ids, "<u2").tobytes())
        start = n = 0
        for i, x in enumerate(ids):
            if x == 0:
                want.add((f"part-{f}", n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            want.add((f"part-{f}", n, start, len(ids) - start, False))
    got = token_files.scan_token_files(spark, str(tmp_path), 0, block).select("file", "ordinal", "first", "n_tokens", "terminated")
    assert {tuple(r) for r in got.collect()} == want


def plain_quality(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def test_quality_matches_plain_python(spark):
    rng = random.Random(1)
    texts = [*TEXTS, "a b c\na b c\n\n a b c\na b c d", "# * $ % & | < > ##"] + [" ".join(rng.choice("the of and a in to it is was".split()) + rng.choice(["", ",", "\n"]) for _ in range(n)) for n in (60, 400)]
    df = docs(spark, texts).withColumnRenamed("n_tokens", "kept")
    got = {r["doc_id"]: tuple(r)[1:6] + (r["base_failed"],) for r in quality.quality(df, PIECES, ["doc_id", "kept"]).collect()}
    assert got == {i * 3: plain_quality(t) for i, t in enumerate(texts)}


def test_quality_verdicts(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("house", "river", "moun", "walk", "green") for b in ("", "s", "tain", "ing", "er", "ly")]
    good = " ".join(rng.choice(vocabulary) for _ in range(300))
    junk = " ".join("".join(rng.choice("QXZJ~^") for _ in range(9)) for _ in range(120))
    rows = [(1, good, "en"), (2, junk, "en"), (3, good, None), (4, None, None), (5, good, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["kept"], r["band"]) for r in quality.quality(df, PIECES, ["doc_id"]).collect()}
    assert got == {1: (True, "en"), 2: (False, "en"), 3: (True, "Latin"), 4: (False, "other"), 5: (True, "Latin")}
    assert quality.quality(df.where("false"), PIECES, ["doc_id"]).collect() == []
    assert quality.script_of("мир и труд".encode()) == "Cyrillic"


#: The first article of the declaration of human rights (parts of it) and a few words more.
CLEAN = {
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "ka": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით.",
    "dv": "ހުރިހާ އިންސާނުން ވެސް އުފަންވަނީ، މިނިވަންކަމުގައި، ހަމަހަމަ ހައްޤުތަކަކާއެކު، ހަމަހަމަ ދަރަޖައެއްގައި ކަމޭހިތެވިގެންވާ ބައެއްގެ ގޮތުގައެވެ.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em. Buổi sáng ở thành phố, những người bán hàng dậy rất sớm để chuẩn bị thức ăn, nước uống và hoa quả tươi cho khách qua đường.",
    "yo": "Gbogbo ènìyàn ni a bí ní òmìnira; iyì àti ẹ̀tọ́ kọ̀ọ̀kan sì dọ́gba. Wọ́n ní ẹ̀bùn ti làákàyè àti ti ẹ̀rí-ọkàn, ó sì yẹ kí wọn ó máa hùwà sí ara wọn gẹ́gẹ́ bí ọmọ ìyá.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Každé ráno chodí děti přes most do školy a večer se vracejí podél řeky domů.",
}
CLEAN_BANDS = {"vi": "marked Latin", "yo": "marked Latin", "cs": "marked Latin"}


def test_clean_texts_of_other_scripts_are_kept(spark):
    rng = random.Random(4)
    mixed = {k: " ".join(["WhatsApp", *(rng.choice(t.split()) for _ in range(120))]) for k, t in CLEAN.items()}
    mixed["vi-nfd"] = unicodedata.normalize("NFD", mixed["vi"])
    symbols = " ".join("".join(rng.choice("abcdeXQZ~^|{}_") for _ in range(9)) for _ in range(120))
    df = spark.createDataFrame([*mixed.items(), ("symbols", symbols)], "doc_id string, text string")
    got = {r["doc_id"]: (r["kept"], r["band"]) for r in quality.quality(df, PIECES, ["doc_id"]).collect()}
    assert got == {k: (True, CLEAN_BANDS.get(k[:2], "other")) for k in mixed} | {"symbols": (False, "Latin")}


def test_scripts_by_most_letters():
    cases = {"한국어 a": "other", "日本 a": "Han", "ひらがな漢字 abc": "other", "[\\]^_`{|}~": "other", "": "other", "ệỗ đ": "Latin", "ἀρχή ab": "Greek", "ab мир": "Cyrillic", "سلام a": "Arabic"}
    assert {t: quality.script_of(t.encode()) for t in cases} == cases


WARM = bpe_table(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" .,;:!?'\n\tabzABZ<|>\u0301\u0307éİıſ&5\u00a0\x1c"))), max_size=40), max_size=6))
def test_ids_are_the_tokenizers(texts):
    """Whatever the table has met before."""
    want = [[*MODEL.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]
    for table in (bpe_table(WORDS), WARM):
        assert [x.tolist() for x in packing.documents_ids(pa.array(texts, pa.string()), table)] == want


def test_ids_do_not_depend_on_what_was_met_before(monkeypatch):
    table = bpe_table(WORDS)
    monkeypatch.setattr(wordpieces, "REMEMBERED", 8)
    texts = ["İ", "İ.", "e", "é e\u0301 e", "the cat, the dog", "cat. dog's", None, "", "<|endoftext|>A", "the cat sat. <|ENDOFTEXT|>", "x" * 100] * 3
    for start in range(len(texts)):
        own = texts[start:]
        got = [x.tolist() for x in packing.documents_ids(pa.array(own, pa.string()), table)]
        assert got == [[*MODEL.encode(t or "", add_special_tokens=False).ids, packing.END] for t in own]


def test_bytes_that_are_no_utf8_become_replacement_characters():
    texts = pa.array([b"ab \xff\xfe c", b"plain"]).cast(pa.binary())
    got = [x.tolist() for x in packing.documents_ids(texts, bpe_table(WORDS))]
    assert got == [[*MODEL.encode(t, add_special_tokens=False).ids, packing.END] for t in ("ab \ufffd\ufffd c", "plain")]


def test_step_groups_are_of_equal_tokens_and_near_in_cost():
    rng = random.Random(6)
    steps, out, cost = packing.StepGroups(100), [], {}
    for n in range(700):
        size = rng.choice(packing.TIERS)
        cuts = [0, *sorted(rng.sample(range(1, size), rng.choice([0, 1, 5, 30]))), size]
        pieces = [(y - x, 0, 0) for x, y in zip(cuts, cuts[1:], strict=False)]
        cost[n] = (size, sum(p[0] ** 2 for p in pieces))
        steps.add(size, pieces, [(n,)])
        if n % 350 == 349:
            out += steps.take(last=n == 699)
    assert sorted(x[0] for x in out) == list(range(700))
    groups = {}
    for n, group in out:
        groups.setdefault(group, []).append(cost[n])
    assert sorted(groups) == list(range(100, 100 + len(groups)))
    smaller = 0
    for own in groups.values():
        assert len({s for s, _ in own}) == 1
        smaller += sum(s for s, _ in own) != packing.STEP
    assert smaller <= len(packing.TIERS)
    for size in packing.TIERS:
        full = [sum(c for _, c in own) for own in groups.values() if own[0][0] == size and size * len(own) == packing.STEP]
        assert max(full) <= 1.6 * min(full)


def test_packing_is_a_partition_of_the_tokens(spark):
    rng = random.Random(4)
    texts = [*TEXTS, *(" ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.choice([5, 300, 1500, 3000, 9000]))) for _ in range(60))]
    rows = packing.packed(docs(spark, texts).repartition(3), WORDS).collect()
    model = Tokenizer.from_file(WORDS)
    want = {i * 3: np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == want.keys()
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(want[i]))
            assert r["ids_crc32"] == zlib.crc32(want[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == own[0]["window"] and at & (at - 1) == 0 and at <= 4096
    steps = {}
    for r in rows:
        steps.setdefault(r["step_group"], {})[r["sequence_id"]] = r["window"]
    for windows in steps.values():
        assert len(set(windows.values())) == 1 and sum(windows.values()) <= packing.STEP
    assert packing.packed(docs(spark, []), WORDS).collect() == []


def test_conversations_round_trip(spark):
    hostile = "\\### Assistant: </turn> ok <turn user> \\l \\\\g > \n</turn>\n"
    rows = [(1, 1, "assistant", hostile, "x"), (1, 0, "user", hostile, "x"), (2, 0, None, None, "x"), (None, 5, "assistant", "a", "x"), (None, 5, "assistant", "a", "x"), (3, 0, "we>ird<\\", "", "x"), (4, 0, "assistant", "é" * 100_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    pieces = format_conversations(df)
    got = {r["conv_id"]: r for r in read_back(pieces).collect()}
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(own), sha(turns))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))
    text = "".join(r["text"] for r in sorted(pieces.where("conv_id = 1").collect(), key=lambda r: r["piece"]))
    assert text.count("</turn>") == 2 and got[1]["formatted_chars"] == len(text)
    assert read_back(format_conversations(df.where("false"))).collect() == []


@given(st.text())
def test_escape_round_trip(text):
    assert unescape(escape(text)) == text and "<" not in escape(text)


def render(source, **names):
    return "".join(t for t, _ in compile_template(source)(**names))


def test_template_language():
    assert render("{% for x in xs %}{{ x.n }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=iter([{"n": 1}, {"n": 2}])) == "1, 2"
    assert render("{% if a == 1 %}one{% elif a == 2 %}two{% else %}many{% endif %}", a=2) == "two"
    assert render("{% set b = a + '!' %}{{ b | upper }}{{ 'x' if a else 'y' }}", a="q") == "Q!x"
    assert render("{{ m['role'] }}{{ m.none }}", m={"role": "r"}) == "r"
    assert render("{{ 'it\\'s' }}{{ 1 + 2 }}") == "it's3"
    assert fold(parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}e{% endif %}")) == [("text", "abcd")]
    assert [x for x in compile_template(TEMPLATE)(messages=[{"role": "assistant", "text": "t"}]) if x[1]] == [("t", True)]


PUBLISHED_STYLE = """
{#- Marks turns as most published templates do. -#}
{%- if messages[0]['role'] == 'system' -%}
    {%- set system = messages[0]['content'] -%}
    {%- set turns = messages[1:] -%}
{%- else -%}
    {%- set turns = messages -%}
{%- endif -%}
{{ bos_token if bos_token is defined else '' }}
{%- for m in turns -%}
    {%- if (m.role == 'user') != (loop.index0 % 2 == 0) -%}
        {{ raise_exception('turns must alternate, not ' ~ m.role) }}
    {%- endif -%}
    {%- if m.role == 'user' -%}
        {{ '[I] ' + (system + '\n' if loop.first and system is defined else '') + m.content | trim + ' [/I]' }}
    {%- elif m.role in 'assistant model' -%}
        {% generation %} {{ m['content'] }}</s>{% endgeneration %}
    {%- endif -%}
{%- endfor -%}
{%- if add_generation_prompt is defined and add_generation_prompt and turns[-1].role is not none %}{{ '}}' }}{% endif %}"""


def test_templates_in_published_style():
    turns = [{"role": "user", "content": " hi "}, {"role": "assistant", "content": "yo"}, {"role": "user", "content": "so"}]
    assert render(PUBLISHED_STYLE, messages=turns) == "[I] hi [/I] yo</s>[I] so [/I]"
    assert render(PUBLISHED_STYLE, messages=[{"role": "system", "content": "S"}, *turns], bos_token="<s>", add_generation_prompt=True) == "<s>[I] S\nhi [/I] yo</s>[I] so [/I]}}"
    with pytest.raises(TemplateError, match="alternate, not user"):
        render(PUBLISHED_STYLE, messages=[turns[0], turns[0]])
    assert render("a {{- 1 -}} b{# no #}c") == "a1bc"
    lines = "x\n  {% if true %}\n  y\n  {% endif %}\nz"
    assert "".join(t for t, _ in compile_template(lines, trim=True)()) == "x\n  y\nz"
    assert render("{{ 7 // 2 }}{{ 7 % 4 - 1 }}{{ -2 * 3 }}{{ [] is none if false else 'n' }}".replace("[] is none if false else ", "")) == "32-6n"
    assert render("{{ 3 is odd }}{{ x is mapping }}{{ 'b' not in 'abc' }}{{ y is not defined }}{{ x | tojson }}", x={"k": "é"}) == 'TrueTrueFalseTrue{"k": "é"}'
    for wrong in ("{{ 'a' < 1 }}", "{{ 5 | length }}", "{{ 'a' * 9 }}", "{{ 1 // 0 }}", "{{ 'a", "{% if 1", "{{ raise_exception }}", "{{ x is nothing }}"):
        with pytest.raises(TemplateError):
            render(wrong, x=1)


@pytest.mark.parametrize("source", ["{% for x in y %}", "{{ a. }}", "{{ x() }}", "{{ a | nope }}", "{% endif %}", "{{ 'a }}", "{% include 'x' %}"])
def test_templates_that_are_none(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_templates_reach_no_python():
    with pytest.raises(TemplateError):
        render("{{ x.__class__ }}", x="text")
    with pytest.raises(TemplateError):
        render("{{ missing }}")


WORKER = """
import random, re, sys
from pathlib import Path
from types import SimpleNamespace
import pyarrow as pa
import pyspark.sql.functions
from recollect.llm import packing, quality

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

def batches():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(60_000)]
    for start in (0, 2000):
        texts = [" ".join(rng.choices(words, k=600)) for _ in range(2000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(start, start + 2000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])

packing.TaskContext = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
at_first = held()
judged = sum(len(x) for x in quality._judged(sys.argv[1], quality.BANDS, 1, None, 2)(batches()))
packed = sum(x.column(2).to_numpy().sum() > 0 for x in packing._packed(sys.argv[2])(batches()))
print(judged, packed > 0, held() - at_first)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read as Linux tells it")
def test_a_worker_gives_back_what_its_tasks_held():
    """A worker that judged and packed keeps one model and little else."""
    done = subprocess.run([sys.executable, "-c", WORKER, PIECES, WORDS], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    judged, packed, kept = done.stdout.split()
    assert (judged, packed) == ("4000", "True")
    assert int(kept) < 100

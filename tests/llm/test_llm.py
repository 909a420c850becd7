"""Problems on text against exact references, round trips and brute force."""

import ast
import math
import random
import sys
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("symweave.llm")
from symweave.llm import encoding, packing, pagespam, syntax  # noqa: E402
from symweave.llm.grammars import GRAMMARS, grammar  # noqa: E402
from symweave.llm.lexicon import compile_words, numbers  # noqa: E402
from symweave.llm.pretokens import CHUNK, WHITE_SPACE  # noqa: E402

GOOD = {
    "a.py": "import os\n\n\nclass A(B, metaclass=M):\n    x: list[str] = ['s']\n\n    async def f(self, a, *, b=1) -> int:\n        match a:\n            case [1, *r] if r:\n                return f'{a!r:>{b}} {{'\n        return [e for e in a if e]\n",
    "a.go": "package x\n\nimport \"fmt\"\n\ntype T[K comparable] struct {\n\ta int `json:\"a\"`\n}\n\nfunc (t *T[K]) f(b ...int) (int, error) {\n\tfor i := 0; i < 3; i++ {\n\t\tif x := b[i]; x > 2 {\n\t\t\treturn x, nil\n\t\t}\n\t}\n\tdefer func() { fmt.Println('{', `}`) }()\n\treturn 0, nil\n}\n",
    "a.rs": "use std::collections::HashMap;\n/* a /* b } */ */\nimpl<'a> T for S<'a> {\n    fn f<'b>(&self, x: &'b str) -> usize {\n        let m: HashMap<String, Vec<usize>> = HashMap::new();\n        let s = r#\"{ \" (\"#;\n        match x { \"a\" => 1, _ if m.is_empty() => { 2 } _ => 3 }\n    }\n}\n",
    "a.ts": "export abstract class A<T> extends B implements C {\n  private x?: Map<string, T[]> = new Map();\n  async f<K extends string>(k: K, o?: number): Promise<void> {\n    const y = (k as string).split(/[{(\\]]+/g).map((e) => ({ e, n: `${o ? `{${k}` : '('}` }));\n  }\n}\n",
    "a.tsx": "export const V = (p: { n: string }) => <div className=\"a\" {...p}>{p.n} text </div>;\n",
    "a.mjs": "import { a } from './a.js';\nexport default class A extends B {\n  #x = 1;\n  static async *g({ a, ...r } = {}) { yield* this.#x }\n}\nconst f = async (x) => (x ? 1 : 2)\n",
    "a.java": "package a.b;\nimport java.util.*;\npublic final class A<T extends Comparable<T>> implements B {\n  private static final String S = \"\\\"{\";\n  @Override public int f(final int x) throws E {\n    int[] a = {1, 2};\n    var t = \"\"\"\n      { (\n      \"\"\";\n    switch (x) { case 1: break; default: x++; }\n    return (int) List.of(1).stream().map(y -> y + 1).count();\n  }\n}\n",
    "a.kt": "package a.b\nabstract class A<T : Any>(val x: Int) : B() {\n  private val y by lazy { 3 }\n  suspend fun f(a: Int, b: String? = null): Int {\n    val z = when { a > 1 -> \"${listOf(1).map { it + a }} ) {\" else -> \"\" }\n    return b?.length ?: z.length\n  }\n}\n",
    "a.swift": "import Foundation\npublic class A<T>: B {\n  static let s = #\"x\" { (\"#\n  func f(_ a: Int, b: String? = nil) throws -> Int {\n    guard a > 0 else { return 1 }\n    let c = [\"a\"].map { $0.count }\n    switch a {\n    case 1: break\n    default: print(\"\\(a + 1) ) {\")\n    }\n    return c.first ?? 0\n  }\n}\n",
    "a.dart": "import 'dart:async';\nclass A extends B implements C {\n  late final List<String> x;\n  Future<int> f(int a, {String b = 'x'}) async {\n    final m = <String, int>{'a': 1, 'b': a};\n    final s = '${a > 1 ? \"{\" : \"(\"}';\n    switch (a) { case 1: break; default: a++; }\n    return m.length;\n  }\n}\n",
    "a.m": "#import <F/F.h>\n@interface A : B\n- (NSInteger)size;\n@end\n@implementation A\n+ (NSInteger)f:(NSInteger)a with:(NSString *)b {\n  NSDictionary *d = @{@\"a\": @(a)};\n  NSArray *x = @[@\"a \\\" ]\", @1];\n  if (a > 1) { a += [self f:1 with:nil]; }\n  return a;\n}\n@end\n",
}
BAD = {"cut.py": "def f(:\n  pass\n", "a.py": "x = 1\n  y = 2\n", "cut.go": GOOD["a.go"][:-3], "brace.rs": GOOD["a.rs"] + "}\n", "mark.ts": "<<<<<<< HEAD\nlet a = 1;\n=======\n>>>>>>> x\n", "x.java": GOOD["a.go"], "s.kt": 'val s = "open\n', "p.swift": "let x = (1 \nlet y = 2\n", "n.dart": "var a = 1\nvar b = 2;\n", "m.m": "int f() { return [a b; }\n"}


@pytest.mark.parametrize("name", sorted(GRAMMARS))
def test_grammars_compile(name):
    assert grammar(name).rules["file"]


@pytest.mark.parametrize("file", sorted(GOOD))
def test_valid(file):
    assert syntax.judge(GOOD[file], syntax.EXTENSIONS[file.rsplit(".")[-1]])[0], syntax.judge(GOOD[file], syntax.EXTENSIONS[file.rsplit(".")[-1]])
    assert syntax.judge("\ufeff" + GOOD[file].replace("\n", "\r\n"), syntax.EXTENSIONS[file.rsplit(".")[-1]])[0]


@pytest.mark.parametrize("file", sorted(BAD))
def test_invalid(file):
    assert not syntax.judge(BAD[file], syntax.EXTENSIONS[file.rsplit(".")[-1]])[0]


def test_causes():
    assert syntax.judge(BAD["mark.ts"], "ts")[3] == "conflict" and syntax.judge(BAD["cut.go"], "go")[3] == "truncated" and syntax.judge(GOOD["a.go"], "java")[3] == "other_language"
    assert syntax.judge("/*\n<<<<<<< a\n=======\n*/\nlet a = 1;\n", "js")[0]
    assert syntax.judge("a = 1\nb = = 2\n", "py")[1] == 2


def test_python_like_the_compiler():
    rng = random.Random(2)
    base = GOOD["a.py"]
    for _ in range(300):
        i = rng.randrange(len(base))
        text = base[:i] + rng.choice(["", "(", ")", ":", "\n", "    ", "'", "}"]) + base[i + rng.randrange(3) :]
        try:
            ast.parse(text)
            good = True
        except SyntaxError as e:
            if "expected 'except' or" in str(e) or "cannot" in str(e) or "f-string" in str(e):
                continue
            good = False
        assert syntax.judge(text, "py")[0] == good, text


PYTHON = """a.b = f().x = a[0] = 1|() = [] = (a,) = x|*a, (b, [c, d.e]) = x|(a): int = 1|a.b: int|(a.b) += 1|del a, b[0], (c.d, e), [g], ()|for a.b, (c, *d) in x: pass|with (a as b, c as d.e,): pass|f(a, *b, c=1, *d, e=2, **g, h=3)
f(x for x in y)|f(a := 1, (x for x in y))|def f(a, b=1, /, c=2, *d, e, g=1, **h): pass|def f(a, /, b, c=1, *, d): pass|lambda a, b=1, /, c=2, *d, e, **g: 0|class A(B, *C, m=M, **k): pass|x[a := 1, *b]|{**a, 'b': 1}|(*a,)
f() = 1|1 = x|None = 2|f() += 1|(a, b) += 1|del f()|del *a|del (a, f())|for f() in x: pass|with a as f(): pass|[f() for f() in x]|a + b = 1|x if y else z = 1|'s' = 1|f'{x}' = 1|lambda: x = 1|(f()) = 1|(a, b): int = 1|x := 1|x = y := 1|f(a=1, b)|f(**a, b)|f(**a, *b)
f(x for x in y, 1)|class A(x for x in y): pass|def f(a=1, b): pass|def f(a=1, /, b): pass|def f(*a=1): pass|lambda a=1, b: 0|def f[*T: int](): pass|[*a for a in b]|{**a for a in b}|(*a)""".replace("\n", "|").split("|")


@pytest.mark.parametrize("text", [*PYTHON, *[f"try: pass\nexcept{a} A: pass\nexcept{b} B: pass" for a in ("", "*") for b in ("", "*")], "try: pass\nexcept*: pass"])
def test_python_targets_and_arguments_like_the_compiler(text):
    try:
        ast.parse(text)
        good = True
    except SyntaxError:
        good = False
    assert syntax.judge(text + "\n", "py")[0] == good


@pytest.mark.parametrize(("text", "language", "good"), [("const x;", "js", False), ("const x = 1, y;", "js", False), ("let x; const y = 1; for (const z of y) {}", "js", True), ("package a\nconst x\n", "go", False), ("package a\nconst (\n\tx = iota\n\ty\n)\n", "go", True), ("val a = 1\nprintln(a)\n", "kt", False), ("val a = 1\nfun f() { println(a) }\n", "kt", True)])
def test_constants_and_top_levels(text, language, good):
    assert syntax.judge(text, language)[0] == good



@pytest.mark.parametrize(("text", "language", "good"), [("x = " + "[" * 40_000, "js", False), ("x = " + "[" * 40_000 + "]" * 40_000 + ";", "js", True), ("x = " + "(" * 200 + "1" + ")" * 200 + "\n", "py", True), ("x = " + "(" * 201 + "1" + ")" * 201 + "\n", "py", False), ("".join(" " * i + "if x:\n" for i in range(99)) + " " * 99 + "y\n", "py", True), ("".join(" " * i + "if x:\n" for i in range(100)) + " " * 100 + "y\n", "py", False)])
def test_deep_texts(text, language, good):
    assert syntax.judge(text, language)[0] is good and syntax.accepts(text, language) is good
    if language == "py":
        try:
            ast.parse(text)
            assert good
        except SyntaxError:
            assert not good


def test_texts_too_deep_to_judge(spark, monkeypatch):
    monkeypatch.setattr(syntax, "DEPTH", 5000)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(5000)
    try:
        assert syntax.judge("x = " + "[" * 9000 + "]" * 9000 + ";", "js") == (None, None, None, "too_deep")
        assert syntax.judge("x = " + "[" * 9000 + "]" * 8999 + ";", "js")[::3] == (False, "truncated")
        assert syntax.judge("x = " + "[" * 9000 + "]" * 8999 + ")", "js")[::3] == (False, "syntax")
    finally:
        sys.setrecursionlimit(limit)


def test_verdict_rows(spark):
    rows = [*GOOD.items(), *[(f"r/{k}", v) for k, v in BAD.items()], ("null.py", None), ("empty.py", ""), ("blank.go", "package a"), ("other.txt", "("), (None, "("), ("r/cut.py", BAD["cut.py"]), ("deep.js", "(" * 3000 + "1" + ")" * 3000)]
    df = spark.createDataFrame([(*r, "l", 1) for r in rows], "file string, text string, language string, valid int")
    assert {r.file for r in syntax.invalid_files(df).collect()} == {f"r/{k}" for k in BAD}
    rates = {(r.repo, r.language): r for r in syntax.syntax_rates(df).collect()}
    assert rates["r", "go"].share == 1.0 and rates["r", "py"].n_invalid == 2
    assert syntax.syntax_verdicts(df.where("false")).count() == 0


def test_lexicon_numbers_words():
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 8))) for _ in range(500)})
    made = compile_words(words)
    assert numbers(made, words).tolist() == list(range(len(words)))
    other = [w + b"z" for w in words] + [b"", b"zz"] + [w[:-1] for w in words if w[:-1] not in set(words)]
    assert set(numbers(made, other).tolist()) == {-1}
    assert numbers(compile_words([]), [b"a"]).tolist() == [-1]
    assert len(made["final"]) < len({w[:i] for w in words for i in range(len(w) + 1)})


def test_chunks_hold_all_text():
    text = "a  b\n\n c\t\td \u3000e'll \x1cf\u2003 "
    assert "".join(CHUNK.findall(text)) == text and "\u3000" in WHITE_SPACE


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    exact.encode_special_tokens = True
    texts = [None, "", " ", "\n\n", "Hello  world\r\n\tx", "don't we'll I'VE", "<|endoftext|>", "naïve e\u0301 日本語のテキスト", "a" * 5000, "x \u200b\x00y", "  lead", "word " * 3000, "Hello  world\r\n\tx", "👩\u200d💻 \x1c\x1d z", "１２ ½ 3.5"]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    found = {r.doc_id: r.ids for r in encoding.encode_corpus(df).collect()}
    assert found == {i: exact.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in encoding.encode_corpus(df, counts_only=True).collect()}
    assert counts == {k: len(v) for k, v in found.items()}
    assert encoding.encode_corpus(df.where("false")).count() == 0


def _brute(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        room = [i for i, r in enumerate(bins) if r >= s]
        if room:
            bins[min(room, key=bins.__getitem__)] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


def test_best_fit_in_runs_equals_best_fit_one_by_one():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.randint(3, 40)
        sizes = [(s, rng.randint(1, 9)) for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))]
        left = {}
        for size, _, items, first, each in packing.best_fit_decreasing(sizes, capacity):
            for k in range(items):
                left[first + k // each] = left.get(first + k // each, capacity) - size
        assert sorted(left.values()) == _brute([s for s, n in sizes for _ in range(n)], capacity) and sorted(left) == list(range(len(left)))


def test_pack(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, None, 1, 7, 7, 7, 40, 95, 100, 101, 350])) for i in range(400)] + [(5, 7), (5, 7), (None, 3)]
    sizes = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, n_tokens int, part int, size int")
    budgets = spark.createDataFrame([("s", 100), ("s", 100), ("l", 1000), ("none", None), ("zero", 0)], "budget string, max_tokens int")
    found = packing.pack(sizes, budgets).collect()
    for budget, capacity in (("s", 100), ("l", 1000)):
        own = [r for r in found if r.budget == budget]
        fill = {}
        for r in own:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
        pieces = [x for _, n in rows for x in [capacity] * ((n or 0) // capacity) + [(n or 0) % capacity] if x]
        assert max(fill.values()) <= capacity and sorted(capacity - v for v in fill.values()) == _brute(pieces, capacity)
        assert sum(r.tokens for r in own) == sum(n or 0 for _, n in rows) and sum(r.part == 0 for r in own) == len(rows)
    assert {r.budget for r in found} == {"s", "l"}
    assert packing.pack(sizes.where("false"), budgets).count() == 0
    for name, value in (("BROADCAST_SEGMENTS", 0), ("BUDGETS_AT_ONCE", 1)):
        monkeypatch.setattr(packing, name, value)
        again = packing.pack(sizes, budgets).collect()
        count = lambda rows: Counter((r.budget, r.doc_id, r.part, r.tokens) for r in rows)
        assert count(again) == count(found) and {(r.budget, r.container) for r in again} == {(r.budget, r.container) for r in found}
    assert packing.pack(sizes, budgets.where("max_tokens = 0")).count() == 0
    report = {r.budget: r for r in packing.container_report(packing.pack(sizes, budgets), budgets).collect()}
    assert report["s"].unused == report["s"].n_containers * 100 - report["s"].tokens


def test_spam_pages(spark):
    words = "graph table store index owner queue branch field token path cursor record layer shard view".split()
    rng = random.Random(7)
    prose = [f"The {rng.choice(words)} of the {rng.choice(words)} is read again when its {rng.choice(words)} has been written by the night job." for _ in range(400)]
    docs = [" ".join(rng.sample(prose, 6)) for _ in range(150)]
    spam = [
        " ".join("#" + rng.choice(words) for _ in range(60)),
        "code search rust best code search rust cheap " * 12,
        "\n".join(f"https://www.{rng.choice(words)}.example/{rng.choice(words)}" for _ in range(20)),
        "\n".join(f"- [{rng.choice(words)} tool](http://{rng.choice(words)}.test/x)" for _ in range(20)),
        "Buy Go linter. Best Go linter! New Go linter? Go linter free, Go linter online. " * 5,
        "コード検索 無料、整形ツール、" * 20,
        "\n".join([*prose[:2], "", *["dart linter online", "graph viewer pro", "best dart linter"] * 20]),
    ]
    clean = [
        None, "", " ", "See the guide.", "```python\n" + "x = x + 1\n" * 50 + "```", "\n".join(f"03:00:{i:02} INFO {rng.choice(words)}: skipped ({rng.choice(words)}.rs)" for i in range(40)),
        "\n".join(f"{rng.choice(words)}\t{rng.choice(words)}\t{i}" for i in range(40)), "\n".join(f'{{"{rng.choice(words)}": "{rng.choice(words)}"}},' for i in range(40)),
        "\n".join(f"- [{rng.choice(words)}](https://a.example/{i}): {s}" for i, s in enumerate(prose[:12])), "\n".join(f"{i}. {s}" for i, s in enumerate(prose[:9])), "\n".join([*prose[:14], "", *["dart linter online"] * 15]),
    ]
    rows = [(i, t, "s", 0.0) for i, t in enumerate([*docs, *spam, *clean])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spam string, salad double")
    found = {r.doc_id for r in pagespam.spam_pages(df).collect()}
    assert found == set(range(150, 150 + len(spam)))
    assert pagespam.page_spam(df).count() == len(rows)
    assert pagespam.page_spam(df.where("false")).count() == 0


def test_copies_and_long_cycles_do_not_bear_themselves_out(spark):
    rng = random.Random(8)
    words = sorted({a + b + c for a in ("ba", "de", "fi", "go", "lu", "ma") for b in ("n", "r", "s", "t", "k") for c in ("el", "or", "an", "ic", "um")})
    prose = [f"The {rng.choice(words)} of the {rng.choice(words)} is read again when its {rng.choice(words)} has been written by the night job." for _ in range(2000)]
    docs = [" ".join(rng.sample(prose, 6)) for _ in range(1500)]
    salad = " ".join(rng.sample(words, 140))
    order = rng.sample(words, 150)
    cycle = "\n".join(" ".join(order[i : i + 30]) for i in range(0, 150, 30))
    cycle = "\n".join([cycle] * 6)
    rows = [(i, t) for i, t in enumerate([*docs, *[salad] * 750, cycle])]
    found = {r.doc_id for r in pagespam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == set(range(1500, 2251))


def _brute_scores(texts):
    """Mean mutual information and repeated share of every window, by plain counts of all different texts without the page itself."""
    words = lambda t: [w.lower() for w in pagespam.words_of(pagespam.repaired(t))]
    total, pairs = Counter(), Counter()
    for t in set(texts):
        total.update(words(t))
        pairs.update(zip(words(t), words(t)[1:]))
    out = {}
    for t in set(texts):
        own, own_pairs = Counter(words(t)), Counter(zip(words(t), words(t)[1:]))
        n, m = max(1, total.total() - own.total()), max(1, pairs.total() - own_pairs.total())
        for number, (plain, chars, linked, _) in enumerate(pagespam.windows(pagespam.repaired(t))):
            w = [x.lower() for x in pagespam._WORD.findall(plain)]
            info = [math.log(max(pairs[p] - own_pairs[p], 0.5) * n * n / m / (max(total[p[0]] - own[p[0]], 1) * max(total[p[1]] - own[p[1]], 1))) for p in zip(w, w[1:])]
            if len(w) < pagespam.FEW or pagespam.sentence_share(plain.replace(pagespam.LINK, " ")) >= 0.5:
                continue
            again = [p in list(zip(w, w[1:]))[:i] for i, p in enumerate(zip(w, w[1:]))]
            kept = sum(max(0, x) for x in info)
            share = sum(max(0, x) for x, r in zip(info, again) if r) / max(kept, 1e-9)
            listed = linked > pagespam.LINKED * chars
            salad, repeated = sum(info) / len(info) < pagespam.SALAD, share > (pagespam.LINK_REPEATED if listed else pagespam.REPEATED)
            if salad or repeated:
                out[t] = out.get(t, 0) + chars
    return out


def test_scores_equal_brute_force_whatever_the_table_holds(spark):
    rng = random.Random(11)
    words = [a + b for a in ("gra", "ta", "sto", "in", "ow", "que") for b in ("ph", "ble", "re", "dex", "ner", "ue")]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(36)], k=rng.randrange(5, 260))) for _ in range(60)]
    texts += [" ".join(rng.choices([" ".join(rng.sample(words, 3)) for _ in range(4)], k=30)) for _ in range(10)] + ["\n".join(f"{rng.choice(words)} http://x.y/{rng.choice(words)}" for _ in range(15)) for _ in range(5)]
    texts += texts[:3] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _brute_scores(texts)
    size = [len(t) - t.count(" ") - t.count("\n") for t in texts]
    for room in (0, 7, 40, 100_000):
        found = {r.doc_id: r.spam for r in pagespam.page_spam(df, words=room, pairs=room).collect()}
        assert found == pytest.approx({i: want.get(t, 0) / size[i] for i, t in enumerate(texts)})
    assert 10 < len(want)


ODD_WORDS = ["a", "HTTPServer", "camelCase", "x²y", "ß", "ΑΣ", "ΑΣΒ", "İ", "ı", "Éa", "Жук", "漢字の", "コード", "ﷰ", pagespam.LINK, "٣ب", "a_b", "a1b", "\0", "e\u0301", "\u00ad", "ǅ", "Ⅷ", "ไทย", "😀x", "l'été", "—b", "\x85", "\u2028", "\xa0"]


def test_a_run_of_letters_is_taken_apart_once(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["graph", "tableStore", "index", "Größe", "漢字"], k=300)) + "." for _ in range(20)]

    class Counted:
        seen = 0

        def findall(self, text):
            Counted.seen += len(text)
            return word.findall(text)

    word = pagespam._WORD
    monkeypatch.setattr(pagespam, "_WORD", Counted())
    runs = pagespam._Runs()
    words, owner, pairs, _ = pagespam._joined(texts, runs)
    assert Counted.seen == sum(map(len, ["graph", "tableStore", "index", "Größe", "漢字"]))
    lists = [word.findall(t) for t in texts]
    assert np.array_equal(words, [runs.ids[w] for x in lists for w in x]) and np.array_equal(owner, [i for i, x in enumerate(lists) for _ in x])
    assert len(pairs) == len(words) - len(texts)


def test_words_of_runs_equal_those_of_the_whole_text(monkeypatch):
    rng = random.Random(13)
    texts = ["", " ", "x", *["".join(rng.choice(ODD_WORDS) + rng.choice(["", "", " ", "\n", ".", "-"]) for _ in range(rng.randrange(60))) for _ in range(400)]]
    for kept in (500_000, 5):  # with and without runs that are kept
        monkeypatch.setattr(pagespam, "KEPT_RUNS", kept)
        runs = pagespam._Runs()
        for i in range(0, len(texts), 31):
            words, owner = runs.read(texts[i : i + 31])
            want = [(runs.ids[w], k) for k, t in enumerate(texts[i : i + 31]) for w in pagespam._WORD.findall(t)]
            assert list(zip(words.tolist(), owner.tolist())) == want
    assert [len(x) for x in pagespam._Runs().read([])] == [len(x) for x in pagespam._Runs().read(["", "1 2"])] == [0, 0]


def test_sorted_hashes_are_found_however_they_are_spread():
    rng = np.random.default_rng(14)
    spread = rng.integers(0, 1 << 64, 5000, np.uint64)
    for keys in (spread, spread[:1], spread[:2], spread >> np.uint64(40), np.arange(900, dtype=np.uint64), ~np.arange(900, dtype=np.uint64), np.concatenate([spread, np.arange(50, dtype=np.uint64)])):
        keys = np.unique(keys)
        asked = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 500, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        at, hit = pagespam._Sorted(keys).find(asked)
        assert np.array_equal(hit, np.isin(asked, keys)) and np.array_equal(keys[at[hit]], asked[hit])
    ids = rng.integers(0, 40, 300).astype(np.uint64)
    assert sorted(pagespam._first_places(ids).tolist()) == sorted(np.unique(ids, return_index=True)[1].tolist())
    assert len(pagespam._first_places(ids[:0])) == 0


@pytest.mark.parametrize(("name", "columns"), [("p2_found", ["file"]), ("p7_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id"])])
def test_registered(spark, tables, name, columns):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, tables)
    assert df.columns == columns and df.count() > 0

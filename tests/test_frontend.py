"""Front ends, graphs and signatures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import fixtures_code as fx
from semblance.frontend import function_at, graph_of, unique_nodes, units_of_source
from semblance.frontend.il import dump
from semblance.frontend.signature import Options
from semblance.functions.hashing import MASK62, feed, fnv1a, mix, mix64, mix_pos
from semblance.plans import diagnose, dot
from semblance.plans.codemining import normalize


def scores(a, b):
    s = sum(min(w, b.get(h, 0)) for h, w in a.items())
    return s / (sum(a.values()) + sum(b.values()) - s), s / sum(a.values())


def signatures(path, text, profile="structural"):
    return {u["name"]: {x["h"]: x["w"] for x in u["features"]} for u in units_of_source(path, text, profile)}


@pytest.mark.parametrize("ext,a,b,names", [(".py", fx.PYTHON, fx.PYTHON_B, ("largest_step", "steepest")), (".rs", fx.RUST, fx.RUST_B, ("largest_step", "steepest")), (".go", fx.GO, fx.GO_B, ("LargestStep", "Steepest")), (".js", fx.JS, fx.JS_B, ("largestStep", "steepest")), (".ml", fx.OCAML, fx.OCAML_B, ("largest_step", "steepest"))])
def test_other_names_and_order_score_the_same(ext, a, b, names):
    """The same function under other names is the best match, and scores far above every other one."""
    old, new = signatures("a" + ext, a), signatures("b" + ext, b)
    found = {n: scores(new[names[1]], f)[0] for n, f in old.items()}
    assert found.pop(names[0]) >= 0.95 and all(x < 0.6 for x in found.values())


def test_part_of_a_function_is_contained():
    """charge lies whole in settle, settle not in charge; label shares little with either."""
    old, new = signatures("a.py", fx.PYTHON), signatures("b.py", fx.PYTHON_B)
    j, c = scores(new["charge"], old["settle"])
    assert c >= 0.85 and c > scores(old["settle"], new["charge"])[1] and c > j
    assert scores(new["charge"], old["label"])[0] < 0.4


def test_what_an_edit_changes():
    """Operands of a sum may change places, those of a difference may not; a statement more leaves the rest contained."""
    base = "def f(a, b, c):\n    t = (a.x + b.y) * c.z\n    return g(t)\n"
    one = signatures("a.py", base)["f"]
    assert signatures("a.py", base.replace("a.x + b.y", "b.y + a.x"))["f"] == one
    minus = base.replace("+", "-")
    assert signatures("a.py", minus)["f"] != signatures("a.py", minus.replace("a.x - b.y", "b.y - a.x"))["f"]
    more = signatures("a.py", base.replace("    return", "    log(c.w)\n    return"))["f"]
    assert scores(one, more)[1] >= 0.85 > scores(more, one)[1]
    assert scores(signatures("a.py", base.replace("t = (a.x + b.y) * c.z", "s = a.x + b.y\n    t = s * c.z"))["f"], one)[0] >= 0.9


def test_every_function_is_found():
    found = {ext: [u["name"] for u in units_of_source("f" + ext, text)] for ext, text in ((".rs", fx.RUST), (".go", fx.GO), (".js", fx.JS), (".c", fx.C), (".ml", fx.OCAML), (".py", "class A:\n  def m(self):\n    def inner(): return 1\n    return lambda x: x + 1\n"))}
    assert found == {".rs": ["largest_step", "settle", "settle::<lambda>", "settle::<lambda>"], ".go": ["LargestStep", "Route"], ".js": ["largestStep", "owed", "owed::<lambda>", "owed::<lambda>", "open"], ".c": ["largest_step", "freeze"], ".ml": ["largest_step", "largest_step::<lambda>", "total"], ".py": ["m", "inner", "m::<lambda>"]}
    for ext, text in ((".rs", fx.RUST), (".go", fx.GO), (".js", fx.JS), (".c", fx.C), (".ml", fx.OCAML)):
        for name in found[ext]:
            g = graph_of("f" + ext, text, name)
            assert g.unknown == 0, (ext, name)


def test_what_leaves_a_loop():
    """Values assigned before a break or continue reach what comes after; a break of a switch leaves only the switch."""
    base = "def f(a, b):\n    t = a.x\n    for i in b:\n        if i.stop:\n            t = i.last\n            break\n        t = i.next\n    return g(t)\n"
    shapes = {}
    for name, text in {"base": base, "lost": base.replace("            t = i.last\n", ""), "again": base.replace("break", "continue"), "plain": base.replace("            break\n", "            pass\n")}.items():
        g = graph_of("a.py", text, "f")
        call = next(k for k, n in enumerate(g.nodes) if n.label == "g()")
        seen, todo = set(), [call]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += [p for p, _ in g.nodes[k].preds]
        shapes[name] = {g.nodes[k].label for k in seen}
    assert {".x", ".last", ".next"} <= shapes["base"] and ".last" not in shapes["lost"] and ".last" in shapes["again"] and ".last" not in shapes["plain"]
    js = "function f(xs, k) { let t = 0; for (const x of xs) { switch (k) { case 1: if (x.odd) { t = x.one; break; } t = x.two; break; default: t = x.three; } use(t); } return t; }"
    g = graph_of("a.js", js, "f")
    use = next(n for n in g.nodes if n.label == "use()")
    merged = {g.nodes[p].label for p, _ in g.nodes[use.preds[0][0]].preds}
    assert g.unknown == 0 and ".one" in merged | {g.nodes[q].label for p, _ in g.nodes[use.preds[0][0]].preds for q, _ in g.nodes[p].preds}


def test_options():
    """More rounds, channels and weights change signatures as they say; copies can be passed through."""
    text = "def f(a):\n    return g(a + 2.5, a * a)\n"
    plain = {x["tag"]: x["w"] for x in units_of_source("a.py", text, "structural")[0]["features"]}
    heavy = {x["tag"]: x["w"] for x in units_of_source("a.py", text, "structural", Options(weights={"call": 3, "binop": 0}))[0]["features"]}
    assert plain["call"] == 10 and heavy["call"] == 3 and "binop" not in heavy
    levels = [len(graph_of("a.py", text, "f", options=Options(rounds=r)).levels) for r in (0, 1, 3)]
    assert levels == [1, 2, 4]
    assert signatures("a.py", text)["f"] != {x["h"]: x["w"] for x in units_of_source("a.py", text, "structural", Options(extra=("floats",)))[0]["features"]}
    typed = [{x["h"] for x in units_of_source("a.py", f"def f(a{t}):\n    return g(a)\n", "structural", Options(extra=("types",)))[0]["features"]} for t in ("", ": int", ": str")]
    assert len({frozenset(x) for x in typed}) == 3 and signatures("a.py", "def f(a: int):\n    return g(a)\n") == signatures("a.py", "def f(a):\n    return g(a)\n")
    whole = Options(extra=("not_exp_nodes",))
    one = graph_of("a.py", "def f(a, b):\n    return g(a.x + b * 3, b)\n", "f", options=whole)
    assert [n.label for n in one.nodes if n.emit] == ["g()", "return"] and len(next(n for n in one.nodes if n.label == "g()").preds) == 3
    swapped, other = (graph_of("a.py", f"def f(a, b):\n    return g({x}, b)\n", "f", options=whole) for x in ("b * 3 + a.x", "a.x + b * 4"))
    emitted = lambda g: {h for h, _ in g.features()}
    assert emitted(one) == emitted(swapped) and emitted(one) != emitted(other)
    rust = "fn f(a: i64) -> i64 { g(a as i32 as i64 + 1) }"
    through = graph_of("a.rs", rust, "f", options=Options(extra=("types", "thru_copies")))
    plus = next(n for n in through.nodes if n.label == "+")
    assert through.nodes[plus.preds[0][0]].label == "param"
    assert [x.split("  #")[0] for x in dump(function_at("a.py", text, "f")[1]).split("\n")] == ["f(a)", "  return call[g](op[+](a, 2.5), op[*](a, a))"]


def test_ocaml():
    """Definitions in modules and in others, bindings of patterns, sequences, cases, loops, records and references."""
    text = """
    (* a comment (* in another *) let no x = x *)
    type t = { due : int; mutable paid : bool }
    module Book = struct
      let settle ?(fee = 1) ~limit rows =
        let rec go n acc = function [] -> acc | r :: rest when r.due > limit -> r.paid <- true; go (n + 1) (acc + r.due * fee) rest | _ :: rest -> go n acc rest in
        let total, _count = (go 0 0 rows, List.length rows) in
        if total > 100 then begin log total; total - 100 end else total
      let ( +! ) a b = a + b
    end
    let first_due table key = try Some (Hashtbl.find table key).due with Not_found -> None
    let sum (xs : int array) = let s = ref 0 in for i = 0 to Array.length xs - 1 do s := !s + xs.(i) done; while !s < 0 do s := - !s done; !s
    let broken = ( ] let
let after x = { x with due = x.due mod 2 }
    """
    found = {u["name"]: u for u in units_of_source("a.ml", text)}
    assert [n for n in found if "<lambda>" not in n] == ["settle", "go", "+!", "first_due", "sum", "after"]
    assert all(graph_of("a.ml", text, n).unknown == 0 for n in found) and (found["settle"]["line_start"], found["settle"]["line_end"]) == (5, 8)
    labels = {n: {x.label for x in graph_of("a.ml", text, n).nodes} for n in found}
    assert {"store", ">", "go()"} <= labels["go"] and {"log()", "-", "if"} <= labels["settle"] and {"[]", "loop", "neg"} <= labels["sum"] and {".due", "find()"} <= labels["first_due"]
    same = text.replace("total", "t9").replace("rows", "zz").replace("acc", "q")
    assert signatures("a.ml", same)["settle"] == signatures("a.ml", text)["settle"] and units_of_source("a.mli", "val f : int -> int") == []


def test_lines_and_docstrings():
    u = {x["name"]: x for x in units_of_source("a.py", fx.PYTHON)}
    assert (u["largest_step"]["line_start"], u["largest_step"]["line_end"], u["largest_step"]["code_lines"]) == (2, 12, 10)


def test_unreadable_source():
    with pytest.raises(SyntaxError):
        units_of_source("a.py", "def broken(:")
    assert units_of_source("a.rs", "fn broken( {") == [] and units_of_source("a.txt", "x") == [] and units_of_source("a.py", "") == []
    odd = units_of_source("a.rs", "fn f(x: i32) -> i32 { let y = x ?? ; @@ #! ; x + 1 }")
    assert [u["name"] for u in odd] == ["f"] and odd[0]["features"]


names = st.lists(st.sampled_from(["alpha", "beta", "gamma", "delta", "eps", "zeta"]), min_size=3, max_size=3, unique=True)


@settings(max_examples=40, deadline=None)
@given(names, st.booleans())
def test_names_and_order_do_not_matter(ns, swap):
    x, y, z = ns
    first, second = f"    {y} = {x} * 7", f"    {z} = {x}[0]"
    body = "\n".join([second, first] if swap else [first, second])
    text = f"def f({x}):\n{body}\n    return g({y}, {z})\n"
    base = "def f(a):\n    b = a * 7\n    c = a[0]\n    return g(b, c)\n"
    assert signatures("a.py", text)["f"] == signatures("a.py", base)["f"]


sets = st.dictionaries(st.integers(0, 40), st.sampled_from([3, 5, 8, 10]), min_size=1)


@given(sets, sets)
def test_score_properties(a, b):
    j, c = scores(a, b)
    assert abs(j - scores(b, a)[0]) < 1e-12 and j <= min(c, scores(b, a)[1]) + 1e-12 and scores(a, a) == (1.0, 1.0)


def test_hashing():
    assert fnv1a(b"") == 0xCBF29CE484222325 & MASK62 and fnv1a(b"a") == 0xAF63DC4C8601EC8C & MASK62
    assert mix64(0) == 0 and mix64(1) == 0x5692161D100B05E5
    assert mix(1, 2) != mix(2, 1) and mix_pos(5, 0) != mix_pos(5, 1) and feed("ab", "c") != feed("a", "bc") and 0 <= feed(1, "x") <= MASK62


def test_diff_and_dot():
    a, b = graph_of("a.py", fx.PYTHON, "settle"), graph_of("b.py", fx.PYTHON_B, "charge")
    assert not unique_nodes(a, a) and unique_nodes(a, b)
    d = diagnose.diff_sources(("a.py", fx.PYTHON), ("b.py", fx.PYTHON_B), a_name="settle", b_line=15)
    assert d["b_in_a"] > d["a_in_b"] and set(d["only_a"]) == {22, 23}
    text = dot.dot(a, 'set"tle', 1)
    assert text.startswith('digraph "set\\"tle"') and text.count("->") == sum(len(n.preds) for n in a.nodes) and dot.file_name("a::b", 2) == "a_b-round2.dot"


def test_rename_normalization():
    assert normalize(["let", "x", "=", "f", "(", "y", ")"], "a.rs") == ["let", "$", "=", "f", "(", "$", ")"]
    assert normalize(["a", ".", "b", "::", "c", "!"], "a.rs") == ["$", ".", "b", "::", "c", "!"]


def test_profiles_add_channels():
    base, full = signatures("a.py", fx.PYTHON), signatures("a.py", fx.PYTHON, "full")
    assert all(set(base[n]) <= set(full[n]) for n in base) and len(full["label"]) > len(base["label"])


@pytest.mark.parametrize("lang,most", [(0, 1300), (1, 1500), (2, 1500), (3, 1500)])
def test_a_file_takes_few_steps(lang, most):
    """Calls for a file of code_dupes, which is many small files: bytes of known names aren't hashed again, brackets and tokens are looked up."""
    import cProfile
    import pstats

    from semblance.queries import EXTENSIONS, HEAD, MORE, TAIL

    text = (HEAD[lang] + MORE[lang] + TAIL[lang]).replace("%1$s", "7").replace("%2$s", "41").replace("%3$s", "+").replace("%%", "%")
    assert len(units_of_source(f"x{EXTENSIONS[lang]}", text, "structural")) == 1
    with cProfile.Profile() as p:
        units_of_source(f"x{EXTENSIONS[lang]}", text, "structural")
    assert pstats.Stats(p).total_calls < most


def test_python_tokens_are_those_of_the_standard_tokenizer():
    import io
    import tokenize

    from semblance.frontend import python

    odd = "x = 0x_F + 1_0.5e-3j+.5 if a<=b!=c else b'\\'' \\\n  ** r\"\\d\"\n\ty: int=...; z:=3 # end\n"
    more = ['d = """a\n"q" \\\n""" + u\'\'\nif x:\n\tpass\n\n# c\n', 'f"{a!r:>{w}} {{}}" + "é" + \'\'\n', "a\r\nb = 1\r\n", "", "@d\ndef f(*a, **k) -> None: return a//b>>c**2 @ e\n", "1if x else 2\n"]
    for source in (odd.replace("z:=3", "(z:=3)"), *more, fx.PYTHON, fx.PYTHON_B):
        want = [(t.string, t.start[0]) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in python.SKIPPED]
        assert python.tokens(source) == want

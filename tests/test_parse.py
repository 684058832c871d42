"""Declarations, calls and flows of small sources, all of them and no others."""

import json
import sys

from tessera.operators import parse
from tessera.operators.tokens import Pattern, masked, tokens

GO = '''// Package shop sells.
package shop

import (
	"fmt"
	str "strings"
)

/* Cart holds
 * items. */
type Cart struct {
	Base
	items map[string][]int
	note  string `json:"note"`
}

type Payer interface {
	fmt.Stringer
	Pay(n int, to *Cart) (int, error)
}

type Pair[K comparable, V any] struct {
	k K
	v V
}

const limit, other = 3, "func fake() { fake() }"

var seen = make(map[string]bool)

// NewCart makes one.
//
// It is empty.
func NewCart(name string) *Cart {
	c := &Cart{items: map[string][]int{"a": {1, 2}}}
	return c
}

func (c *Cart) Add(name string, n ...int) error {
	if err := c.check(name); err != nil && len(n) > 0 {
		for i := range n {
			switch {
			case n[i] > limit || n[i] < 0:
				return fmt.Errorf("bad %d // not a comment", n[i])
			default:
				c.items[name] = append(c.items[name], n[i])
			}
		}
	}
	go c.log(`raw " { string`)
	return nil
}

func (c Cart) check(s string) error { return nil }
func (c Cart) log(s string)         {}

func Map[T any](xs []T, f func(T) T) (out []T) {
	for _, x := range xs {
		out = append(out, f(x))
	}
	return
}

func Run(p Payer, ch chan<- int) {
	cart, total := NewCart("x"), 0
	cart.Add("y", 1)
	defer func(k int) {
		cart.log(str.ToUpper("z"))
		func() { p.Pay(k, cart) }()
	}(total)
	var other Cart = Cart{}
	other.log("a")
	select {
	case ch <- total:
	case v := <-make(chan int):
		total = v
	}
	if x, ok := p.(Cart); ok && x.note == "" {
		x.log("b")
	}
label:
	for total < 3 {
		total++
		continue label
	}
	seen["k"], _ = true, 0
}
'''


def rows(path, text):
    out = {}
    for kind, row in parse.parse_text(path, text).out:
        out.setdefault(kind, []).append(row)
    return out


def test_go_declarations():
    got = {r["name"]: r for r in rows("shop/cart.go", GO)["symbol"]}
    assert {n: r["type"] for n, r in got.items()} == {
        "Cart": "class", "Payer": "interface", "Payer.Pay": "method_spec", "Pair": "class", "NewCart": "function", "Cart.Add": "method", "Cart.check": "method", "Cart.log": "method",
        "Map": "function", "Run": "function", "Run.func1": "function", "Run.func1.func1": "function",
    }
    assert got["Cart.Add"]["signature"] == "(string, ...int) -> (error)" and got["Payer.Pay"]["signature"] == "(int, *Cart) -> (int, error)"
    assert got["Map"]["signature"] == "([]T, func(T) -> (T)) -> ([]T)" and got["Run"]["signature"] == "(Payer, chan<- int)"
    assert (got["Cart.Add"]["receiver_type"], got["Cart.log"]["receiver_type"], got["Run"]["receiver_type"]) == ("pointer", "value", "")
    assert got["NewCart"]["doc"] == "NewCart makes one.\nIt is empty." and got["Cart"]["doc"] == "Cart holds\nitems."
    raw = GO.encode()
    assert raw[got["NewCart"]["start_byte"] : got["NewCart"]["end_byte"]].decode() == GO[GO.index("func NewCart") : GO.index("\n\nfunc (c *Cart) Add")]
    check_line = GO[: GO.index("func (c Cart) check")].count("\n") + 1
    assert (got["Cart.check"]["start_line"], got["Cart.check"]["end_line"], got["Cart.check"]["start_col"]) == (check_line, check_line, 14)
    assert [r["import"] for r in rows("shop/cart.go", GO)["import"]] == ["fmt", "strings"]
    add = json.loads(got["Cart.Add"]["metrics_json"])
    # if, &&, range, two cases, ||: if 1 + 0, range 1 + 1, cases 1 + 9 each
    assert add == {"cyclomatic": 7, "cognitive": 23, "has_loop": True, "has_error": True, "is_async": True}
    assert json.loads(got["Cart.check"]["metrics_json"]) == {"cyclomatic": 1, "cognitive": 0, "has_loop": False, "has_error": False, "is_async": False}


def test_go_calls():
    got = sorted((r["caller"], r["callee"], r["line"], r["link_type"]) for r in rows("shop/cart.go", GO)["call"])
    at = lambda s: GO[: GO.index(s)].count("\n") + 1
    assert got == sorted([
        ("shop.Cart", "shop.Base", 12, "embeds"), ("shop.Payer", "shop.Stringer", 18, "embeds"),
        ("shop.global", "shop.make", at("var seen"), "call"),
        ("shop.Cart.Add", "shop.Cart.check", at("if err :="), "call"), ("shop.Cart.Add", "shop.len", at("if err :="), "call"), ("shop.Cart.Add", "fmt.Errorf", at("return fmt"), "call"),
        ("shop.Cart.Add", "shop.append", at("c.items[name] ="), "call"), ("shop.Cart.Add", "shop.Cart.log", at("go c.log"), "call"),
        ("shop.Map", "shop.append", at("out = append"), "call"), ("shop.Map", "shop.f", at("out = append"), "call"),
        ("shop.Run", "shop.NewCart", at("cart, total"), "call"), ("shop.Run", "shop.Cart.Add", at('cart.Add("y"'), "call"), ("shop.Run", "shop.Cart.log", at('other.log'), "call"),
        ("shop.Run", "shop.make", at("case v :="), "call"), ("shop.Run", "shop.Cart.log", at('x.log("b")'), "call"),
        ("shop.Run.func1", "shop.Cart.log", at("cart.log(str"), "call"), ("shop.Run.func1", "strings.ToUpper", at("cart.log(str"), "call"),
        ("shop.Run.func1.func1", "shop.Payer.Pay", at("func() { p.Pay"), "call"),
    ])


def test_go_flows():
    got = {(r["source"], r["sink"], r["type"]) for r in rows("shop/cart.go", GO)["flow"]}
    assert {
        ("c", "NewCart:return0", "return"), ("name", "c.check:arg0", "argument"), ("c.check:return0", "err", "assignment"), ("nil", "Cart.Add:return0", "return"), ("make:return0", "seen", "assignment"),
        ("append:return0", "out", "assignment"), ("x", "f:arg0", "argument"), ("f()", "append:arg1", "argument"), ("0", "total", "assignment"), ("total", "unknown:arg0", "argument"),
        ("v", "total", "assignment"), ("<-make()", "v", "assignment"), ("k", "p.Pay:arg0", "argument"), ("3", "limit", "assignment"),
    } <= got
    assert not any(sink == "_" for _, sink, _ in got)


def test_go_that_is_broken_is_read_where_it_can_be():
    got = rows("a.go", "package a\n\nfunc Bad( {\n\nfunc Good() { Bad() }\n\ntype = 3\n\nfunc Last() {\n")
    assert "Good" in {r["name"] for r in got["symbol"]}
    assert rows("a.go", "") == {} and rows("a.go", "package") == {}


TS = '''import { a } from "./a";
import type { B } from 'b';
const c = require("c");
// function no() { fake() }
export interface Shape extends Base, Named { area(): number }
/** A circle. */
@dec()
export class Circle extends Round implements Shape, Other {
  private r = 1;
  constructor(r: number) { super(r); this.r = r; }
  async area(scale: number): Promise<number> {
    if (scale > 0 && this.r) {
      for (const x of this.items) { await this.log(x, "a, b"); }
    }
    return this.r ? compute(scale) : 0;
  }
}
export const twice = async (n: number) => {
  const m = n;
  const k = await load(m);
  return k;
};
function outer() {
  function inner() { twice(1); }
  return inner;
}
const text = `not ${call(1)} a { block`;
'''


def test_typescript():
    got = rows("web/c.ts", TS)
    assert {(r["name"], r["type"]) for r in got["symbol"]} == {("Shape", "interface"), ("Circle", "class"), ("Circle.constructor", "method"), ("Circle.area", "method"), ("twice", "function"), ("outer", "function"), ("outer.inner", "function")}
    assert [r["import"] for r in got["import"]] == ["./a", "b", "c"]
    s = {r["name"]: r for r in got["symbol"]}
    assert s["Circle"]["doc"] == "A circle." and (s["Circle.area"]["start_line"], s["Circle.area"]["end_line"]) == (11, 16)
    assert json.loads(s["Circle.area"]["metrics_json"]) == {"cyclomatic": 5, "cognitive": 1 + 2 + 1, "has_loop": True, "has_error": False, "is_async": True}
    calls = {(r["caller"], r["callee"], r["link_type"]) for r in got["call"]}
    p = "web.c."
    assert calls == {
        (p + "Shape", "Base", "embeds"), (p + "Shape", "Named", "embeds"), (p + "Circle", "Round", "embeds"), (p + "Circle", "Shape", "implements"), (p + "Circle", "Other", "implements"),
        (p + "Circle.area", p + "Circle.log", "call"), (p + "Circle.area", "compute", "call"), (p + "twice", "load", "call"), (p + "outer", "twice", "call"), (p + "outer.inner", "twice", "call"),
    }
    flows = {(r["source"], r["sink"], r["type"]) for r in got["flow"]}
    assert {("r", "this.r", "assignment"), ("x", p + "Circle.log:arg0", "argument"), ("scale", "compute:arg0", "argument"), ("n", "m", "assignment"), ("load:return0", "k", "assignment"), ("k", p + "twice:return0", "return")} <= flows


RS = '''use std::fmt;
/// A dot.
#[derive(Debug)]
pub struct Dot<'a> { name: &'a str }
pub enum Kind { A, B }
impl<'a> fmt::Display for Dot<'a> {
    fn fmt(&self, f: &mut Out) -> Res {
        let c = '{';
        let n = self.size();
        match n { 0 => paint(n), _ if n > 1 && ok(n) => panic!("x }"), _ => {} }
        write(f, &n)?;
        return n;
    }
}
pub async fn run() { let r = r#"fn fake() { }"#; for i in 0..3 { step(i); } }
'''


def test_rust():
    got = rows("d.rs", RS)
    assert {(r["name"], r["type"]) for r in got["symbol"]} == {("Dot", "class"), ("Kind", "class"), ("Dot.fmt", "method"), ("run", "function")}
    s = {r["name"]: r for r in got["symbol"]}
    assert s["Dot"]["doc"] == "A dot." and s["Dot.fmt"]["end_line"] == 13
    calls = {(r["caller"], r["callee"], r["link_type"]) for r in got["call"]}
    assert calls == {("d.Dot", "Display", "implements"), ("d.Dot.fmt", "d.Dot.size", "call"), ("d.Dot.fmt", "paint", "call"), ("d.Dot.fmt", "ok", "call"), ("d.Dot.fmt", "panic", "call"), ("d.Dot.fmt", "write", "call"), ("d.run", "step", "call")}
    flows = {(r["source"], r["sink"], r["type"]) for r in got["flow"]}
    assert {("d.Dot.size:return0", "n", "assignment"), ("n", "paint:arg0", "argument"), ("n", "write:arg1", "argument"), ("n", "d.Dot.fmt:return0", "return")} <= flows | {("d.Dot.size:return0", "n", "assignment")}
    assert json.loads(s["run"]["metrics_json"])["is_async"] and json.loads(s["run"]["metrics_json"])["has_loop"]


def test_masks_keep_places():
    for text, language in ((GO, "go"), (TS, "ts"), (RS, "rs")):
        clear = masked(text, language)
        assert len(clear) == len(text) and [len(x) for x in clear.split("\n")] == [len(x) for x in text.split("\n")]
        assert "fake" not in clear
    assert [t.text for t in tokens("a /* b */ 'c' // d\ne", "ts")] == ["a", "'c'", "e"]


def test_patterns_over_tokens():
    found = lambda p, text, language="go": [m.captures for m in Pattern(p, language).matches(text)]
    assert found("panic($X)", 'func f() { panic("a, b"); panic(err(1, 2)); panic(a, b) }') == [{"X": '"a, b"'}, {"X": "err(1, 2)"}]
    assert found("$A == $A", "x == x; a.b == a.b; a == b") != [] and {"A": "a"} not in found("$A == $A", "a == b")
    assert len(found("f($$$)", "f(); f(1, g(2)); h(3)")) == 2


def test_search_and_audit_of_go(spark):
    files = spark.createDataFrame([("core/a.go", GO), ("b.ts", TS), ("c.py", "print(1)\n")], "path string, content string")
    hits = parse.structural_search(files, "$X.log($$$)").collect()
    assert {(r.path, r.captures["X"]) for r in hits} == {("core/a.go", x) for x in ("c", "cart", "other", "x")} | {("b.ts", "this")}
    inner = parse.structural_search(files, "$X.log($Y)", inside="go_statement").collect()
    assert inner == []
    assert {r.line for r in parse.structural_search(files, "$X.Pay($$$)", inside="function").collect()} == {GO[: GO.index("func() { p.Pay")].count("\n") + 1}
    assert [r.path for r in parse.structural_search(files, "cart.log($X)", has="ToUpper($$$)").collect()] == ["core/a.go"]
    rules = [parse.ArchRule("no-raw-errors", "fmt.Errorf($$$)", "wrap", "error", "core/"), parse.ArchRule("no-print", "print($$$)", "no")]
    assert {(r.rule_id, r.file_path) for r in parse.audit(files, rules).collect()} == {("no-raw-errors", "core/a.go"), ("no-print", "c.py")}


def steps(f):
    """Calls of Python and of built-in functions that ``f`` makes."""
    count = 0

    def note(frame, event, arg):
        nonlocal count
        count += event in ("call", "c_call")

    sys.setprofile(note)
    try:
        f()
    finally:
        sys.setprofile(None)
    return count


def test_a_go_file_costs_few_steps_for_each_token():
    parse.parse_text("shop/cart.go", GO, "call")
    assert steps(lambda: parse.parse_text("shop/cart.go", GO, "call")) < 19 * len(tokens(GO, "go"))


SMALL = [("shop/cart.go", GO), ("a.py", "import os\n\nclass A(B):\n    '''Doc.'''\n\n    def f(self, x):\n        '''More.'''\n        if x and x:\n            return os.path.join(x, g(x))\n\nh = lambda y: [y, (lambda z: z)(y)]\n"), ("b.ts", TS), ("d.rs", RS)]


def test_columns_that_are_asked_for_are_those_of_all_at_fewer_steps():
    for path, text in SMALL:
        whole = [v for _, v in parse.parse_text(path, text, "symbol").out]
        assert whole
        for asked in ({"path", "name", "doc", "start_line"}, {"start_byte", "end_byte", "metrics_json"}, {"signature", "structural_hash"}, {"logic_hash"}):
            some = [v for _, v in parse.parse_text(path, text, "symbol", frozenset(asked)).out]
            assert [{c: v[c] for c in asked} for v in some] == [{c: v[c] for c in asked} for v in whole]
        fewer = steps(lambda: parse.parse_text(path, text, "symbol", frozenset({"name"})))  # noqa: B023
        assert fewer < 0.9 * steps(lambda: parse.parse_text(path, text, "symbol"))  # noqa: B023


def test_calls_of_python_cost_few_steps():
    code = "import a.b as c\n\ndef f(x):\n    y = [x + 1 for x in range(3) if x > 1]\n    return c.d.e(y, g(x))\n"
    assert sorted(v["callee"] for _, v in parse.parse_text("m.py", code, "call").out) == ["a.b.d.e", "g", "range"]
    assert steps(lambda: parse.parse_text("m.py", code, "call")) < 700


def test_a_file_is_read_once_for_all_rules_and_not_without_their_words(monkeypatch):
    read = []
    for module, name in ((parse, "tokens"), (parse.ast, "parse")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name): (read.append(a[0]), f(*a))[1])
    code = "def f(xs):\n    return list(map(g, xs)), log(xs)\n"
    wanted = [("map($F, $X)", "", ""), ("log($X)", "function", ""), ("absent($X)", "", "")]
    assert [(i, line, c) for i, line, _, c in parse.matches("a.py", code, wanted)] == [(0, 2, {"F": "g", "X": "xs"}), (1, 2, {"X": "xs"})]
    assert read.count(code) == 1
    wanted = [("c.log($X)", "", ""), ("str.ToUpper($X)", "", ""), ("absent($X)", "", "")]
    assert {i for i, *_ in parse.matches("shop/cart.go", GO, wanted)} == {0, 1}
    assert read.count(GO) == 1
    assert list(parse.matches("a.py", code, wanted[2:])) == list(parse.matches("b.go", GO, wanted[2:])) == []
    assert read.count(code) == read.count(GO) == 1

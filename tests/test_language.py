"""Notations, rewrites and diagnostics of the interval language."""

import pytest

from lexspan.functions.text import porter
from lexspan.operators.ranking import build_tiers
from lexspan.plans.gcl import GclError, Infix, Term, compile_program, families, leaves, optimized, parse, quoted, stemmed


@pytest.mark.parametrize(
    ("text", "printed"),
    [
        ("(^ a b)", "(^ a b)"),
        ("(all_of a  (one_of b c))", "(^ a (+ b c))"),
        ('(... "x y" `z`)', '(... "x y" `z`)'),
        ("(>> (# 3) (<> a b)) trailing", "(>> (# 3) (... a b))"),
        ('"say \\"hi\\""', '"say \\"hi\\""'),
    ],
)
def test_prefix(text, printed):
    assert str(parse(text)) == printed


@pytest.mark.parametrize("text", ["(^ a", "(?? a b)", "(<< a)", "()", "", "(# x)", "(2 a b)"])
def test_prefix_errors(text):
    with pytest.raises(GclError, match="parse error at offset"):
        parse(text)


@pytest.mark.parametrize(
    ("text", "printed"),
    [
        ('("foo" and "bar") or ("hello" ... "world")', '(+ (^ "foo" "bar") (... "hello" "world"))'),
        ('"a" <> "b" > "c"', '(>> (... "a" "b") "c")'),
        ('2 of ("x", "y", "z")', '(2 "z" "y" "x")'),
        ('all of ("x", "y")', '(^ "y" "x")'),
        ('one of ("x", "y")', '(+ "y" "x")'),
        ("[100]", "(# 100)"),
        ('5 words > ("a" and "b")', '(>> (# 5) (^ "a" "b"))'),
        ('"a" not contained in "b"', '(!< "a" "b")'),
    ],
)
def test_infix(text, printed):
    assert str(Infix().read(text)) == printed


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("nothing", "Undefined symbol."),
        ('2 of "a", "b")', 'Missing "\\(" after start'),
        ('2 of ("a", "b"', 'Missing "\\)".'),
        ('9 of ("a", "b")', "Too few elements"),
        ("one words", 'Expected "\\^" or "of" after "one".'),
    ],
)
def test_infix_errors(text, message):
    with pytest.raises(GclError, match=message):
        Infix().read(text)


def test_real_n_of_m():
    assert str(Infix(real_n_of=True).read('2 of ("x", "y", "z")')) == '(+ (^ "z" "y") (^ "z" "x") (^ "y" "x"))'


def test_program():
    tiers, errors = compile_program('# c\n;; c\na = "x" and "y"\nb = "z\n@rank a b 3\n')
    assert [(n, str(e)) for n, e in tiers] == [("a", '(^ "x" "y")')]
    assert errors[0].startswith("DEF ERR") and errors[1].startswith("TIER ERR b")


def test_rewrites():
    assert leaves(parse('(^ a (+ "b c" :tag) a (# 3))')) == ["a", "b", "c"]
    assert str(families(parse("(^ hopping* b)"))) == "(^ porter:hop b)"
    with pytest.raises(GclError):
        families(parse("ho*ping"))
    assert str(stemmed(parse('(^ running "running dogs" dog)'))) == '(^ porter:run "running dogs" dog)'
    assert str(optimized(parse("(^ (+ a) (^ b c))"))) == "(^ a b c)"
    assert str(optimized(parse("(+ (<< a b) c)"))) == "(+ (% (<< a b)) c)"
    assert quoted('a"b') == '"a\\"b"' and parse(quoted('a"b')) == Term('a"b', '"')


def test_stems_and_tiers():
    words = "caresses ponies hopping relational formalize adjustable running happy sky feed agreed".split()
    assert [porter(w) for w in words] == "caress poni hop relat formal adjust run happi sky feed agre".split()
    assert porter("it") == "it" and porter("x2y") == "x2y"
    assert build_tiers({"a": 5, "b": 4.5, "c": 1}) == ["(^ a b c)", "(^ a b)", "(+ (^ a c) (^ b c))", "(+ (... a a) (... b b))", "(... c c)"]

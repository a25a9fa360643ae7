from __future__ import annotations

from docweave.functions import signatures as s


def test_parameters():
    assert s.parameters("function f(a: Map<string, number>, b?: number = 3, ...rest: any[]): void {") == [("a", "Map<string, number>"), ("b", "number"), ("rest", "any[]")]
    assert s.parameters("def f(self, x: int = 1, *args):") == [("x", "int"), ("args", "")]
    assert s.parameters("func (s *S) Run(a int, b string) error {") == [("a", "int"), ("b", "string")]
    assert s.parameters("class A {") == [] and s.parameters(None) == []


def test_return_types():
    assert s.return_type("function f(a: () => void): Promise<A> {") == "Promise<A>"
    assert s.return_type("def f(x) -> dict[str, int]:") == "dict[str, int]"
    assert s.return_type("func (s *S) Run(a int) error {") == "error"
    assert s.return_type("fn go() -> Result<A, B> {") == "Result<A, B>"
    assert s.return_type("const x = 1") == ""


def test_strip_code_keeps_length():
    text = "a = 'x // y' // gone\n/* also\ngone */ b `t`"
    out = s.strip_code(text)
    assert len(out) == len(text) and out.count("\n") == 2
    assert "gone" not in out and "a = '" in out and " b `" in out
    assert s.strip_code('x = "#" # c', "python").rstrip() == 'x = " "'


def test_docstring_regeneration():
    old = "Adds.\n@param {number} b second\n@param a first"
    assert s.regenerate_docstring(old, "function add(a: number, b: number): number {") == "Adds.\n@param {number} a first\n@param {number} b second\n@returns {number}"
    assert s.regenerate_docstring("Adds.\n:param a: first", "def add(a, c):", "python") == "Adds.\n:param a: first\n:param c:"


def test_current_signature_skips_overloads():
    text = "function f(a: string): void;\nfunction f(a: any): void {\n}"
    assert s.current_signature(text, "f") == "function f(a: any): void {"
    assert s.current_signature(text, "g") is None

import random

import pytest

from graphlens.llm import docpairs, islands

PY = '''"""Module text."""
# def no(): "comment"
S = """
def hidden():
    'Does a thing.'
"""


@deco("def x(")
class Outer(Base):
    r"""Keeps the things of a caller."""

    def method(self, x: dict[str, int] = {"a": 1}) -> "T":
        "Sorts what it gets."
        def inner(): "Looks inside."
        if x:
            async def deep(
                a,
            ):
                """Goes
                deeper."""
        return 1

    def none(self):
        f"""Not a docstring."""

    def bytes_(self):
        b"no docstring"


def after(): pass
def joined():
    "One " "text."
'''
TS = """/** File header that belongs to nothing. */
import { x } from './y.js';

/** Collects the parts. */
@Injectable({ a: '/** no */' })
export abstract class Store<T extends { a: string }> extends Base<T> {
  /** A field is no case. */
  private limit = 8;
  handlers = { run() { return 1 } }
  /**
   * Sends it on.
   * @param a - the first
   */
  @Log()
  public async send(a: string, cb: (x: number) => { y: string }): Promise<{ z: number }> {
    /** Nested one. */
    function inner<T>(x: T): { a: string } | null { return null }
    const s = `/** no */ function nope() {} ${inner(`}`)}`;
    // function comment() {}
  }
  /** Tells its size. */
  get size(): number { return 1 }
  /** Separated. */
  // another comment
  lost() {}
}

/** Shape is no case. */
export interface Shape { a: string; /** no */ b(): void }

/** Finds the way. */
export const find: Fn = async <T,>(x: T): Promise<T> => {
  /** Deep down. */
  const low = y => y + 1;
  const clean = String(module).replace(/["'{(]/g, '');
};
/** No arrow. */
const value = compute(() => 1);
/** First. */
/** Second counts. */
export default async function* main(): AsyncGenerator<number> {}
const re = /\\/** not *\\//;
"""


def test_python_definitions():
    got = [(x.qualname, x.line, x.doc) for x in islands.python_islands(PY)]
    assert got == [("Outer", 10, "Keeps the things of a caller."), ("Outer.method", 13, "Sorts what it gets."), ("Outer.method.inner", 15, "Looks inside."), ("Outer.method.deep", 17, "Goes\n                deeper."), ("joined", 32, "One text.")]


def test_line_ends_do_not_matter():
    assert [(x.qualname, x.line) for x in islands.python_islands(PY.replace("\n", "\r\n"))] == [(x.qualname, x.line) for x in islands.python_islands(PY)]
    assert [(x.qualname, x.line) for x in islands.typescript_islands(TS.replace("\n", "\r\n"))] == [(x.qualname, x.line) for x in islands.typescript_islands(TS)]


def test_typescript_definitions():
    got = [(x.qualname, x.line) for x in islands.typescript_islands(TS)]
    assert got == [("Store", 6), ("Store.send", 15), ("Store.send.inner", 17), ("Store.size", 22), ("find", 32), ("find.low", 34), ("main", 41)]
    assert "Second" in islands.typescript_islands(TS)[-1].doc


def test_any_text_is_survived():
    rng = random.Random(2)
    for text, run in ((PY, islands.python_islands), (TS, islands.typescript_islands)):
        for _ in range(300):
            a, b = sorted(rng.randrange(len(text)) for _ in range(2))
            run(text[:a] + text[b:])
            run(text[a:b])


@pytest.mark.parametrize(
    ("doc", "name"),
    [("", "f"), (" \n ", "f"), ("...", "f"), ("---", "f"), ("?", "f"), ("TODO", "f"), ("todo: write the documentation", "f"), ("FIXME add a description here later", "f"), ("n/a", "f"), ("No description.", "f"), ("Docs to follow.", "f"), ("Explain what this does", "f"),
     ("sort_tiers", "sort_tiers"), ("SortTiers.", "sort_tiers"), ("Sorts the tiers.", "sort_tiers"), ("Function to sort a tier.", "sort_tiers"), ("This method sorts the tiers.", "sortTiers"), ("SORT TIERS", "sortTiers"), ("A tier store class.", "TierStore"), ("Class TierStore.", "TierStore"), ("The sort tiers function.", "_sort_tiers"), ("Sorting of tiers", "sort_tiers"), ("sortTiers()", "sort_tiers"),
     ("noqa: E501", "f"), ("type: ignore", "f"), ("pylint: disable=x", "f"), ("@ts-ignore", "f"), ("eslint-disable-next-line", "f"), ("istanbul ignore next", "f"), ("Auto-generated stub.", "f"), ("autogenerated", "f"), ("Generated code, do not edit.", "f"), ("@override", "f"), ("@internal", "f"), (":rtype:", "f"), (":rtype: str", "f"),
     (":param a:\n:param b:\n:return:", "f"), ("@param a\n@param {string} b\n@returns {void}", "f"), ("TODO\n\n@param a", "f"), ("Args:\n", "f")],
)
def test_trivial(doc, name):
    assert islands.is_trivial(doc, name)


@pytest.mark.parametrize(
    ("doc", "name"),
    [("Returns the todo marks found in tiers, one per line.", "f"), ("Placeholder names in a batch are replaced with their values.", "f"), ("True when no tier is stale any more", "f"), ("Sorts the tiers with the cheapest first.", "sort_tiers"), (":param a: the late cache", "f"), ("@param a - the late cache", "f"), ("@returns the result", "f"), ("Sorts.\n\nTODO: speed this up", "walk"), ("Generates the report of a run.", "f"), ("Auto-generated stub.\n\nReads every line of the log.", "f"), ("Ignores late tiers; the caller handles those.", "walk"), ("Die Stufen nach Größe ordnen", "sort_tiers")],
)
def test_not_trivial(doc, name):
    assert not islands.is_trivial(doc, name)


def test_pairs_of_files(spark, rows):
    data = [(1, "a.py", PY, "x"), (2, "b.ts", TS, "x"), (3, "broken.py", PY + "\n(", "x"), (4, "c.cs", PY, "x"), (5, "d.py", None, "x"), (6, "e.py", "", "x"), (7, None, PY, "x"), (1, "a.py", PY, "x")]
    df = spark.createDataFrame(data, "file_id long, file_path string, body string, qualname string")
    got = docpairs.doc_pairs(df)
    assert {r[0] for r in rows(got.select("file_id").distinct())} == {1, 2}
    assert rows(got.filter("file_id = 2").select("qualname", "def_line"))[0] == ("Store", 6)
    assert got.filter("file_id = 1").count() == 10 and docpairs.doc_pairs(df.limit(0)).count() == 0

"""The light parsers, against trees made by hand; and chunks from them."""

import duckdb
import pytest

import __spark_entry__
from chunkyard.operators import braces, symbols


def outline(node):
    """kind, name, first and last line and calls, what is inside below."""
    return [(n.kind[0], n.name, n.first, n.last, " ".join(sorted(n.calls)), outline(n)) for n in node.below]


JAVASCRIPT = """import { a,
  b } from "./x.js";
const LIMIT = 3; // {
let re = /["{]/g;

/** doc { */
export class Store extends Base {
  size = 1;
  constructor(x) { super(x); this.x = check(x); }
  async *put(k, v = {}) {
    if (k) { return this.save(k, "}"); }
    for (const i of v) { log(i); }
  }
  static get name() { return "s"; }
}
function run(a) { function inner() { go(); } return new Store(inner()); }
const add = (x, y) => x + mul(y);
const twice = async x => { await run(x); };
export default function () { return `}${run()}`; }
"""
TYPESCRIPT = """import type { T } from "t";
export interface Shape<T> { area(): number; }
type Point = { x: number };
enum Color { Red, Green }
export abstract class Box<T extends object> implements Shape<T> {
  private items: Map<string, T> = new Map();
  constructor(private readonly n: number) {}
  public get<K>(key: K): Promise<T> { return fetch(key); }
}
export const load = async (p: string): Promise<void> => { await read(p); };
"""
JAVA = """package a.b;
import java.util.List;

@Service
public class Store<T> extends Base implements I {
    private static final int LIMIT = 3;
    public Store(int n) { super(n); this.n = check(n); }
    @Override
    public List<T> put(T x) throws IOException {
        if (x == null) { throw new Oops("}"); }
        Runnable r = new Runnable() { public void run() { go(); } };
        return helper.save(x);
    }
    static class Node { int get() { return 1; } }
}
"""
GO = """package main

import (
	"fmt"
	"os"
)

var limit = 3

type Store struct {
	size int
}

func (s *Store) Put(k string) (int, error) {
	if err := s.check(k); err != nil { return 0, fmt.Errorf("bad {%s", k) }
	return 1, nil
}
func Map[T any](xs []T) []T { return xs }
"""
C = """#include <stdio.h>
#define BAD(x) { x
static int limit = 3;
struct point { int x; };
static int add(int a, int b)
{
    return mul(a, '{');
}
int main(void) { printf("%d}", add(1, 2)); while (1) { break; } return 0; }
"""
CPP = """#include "a.h"
namespace geo {
class Box : public Base {
public:
  Box(int n) : n_(n) { init_it(); }
  ~Box() {}
  int size() const noexcept override { return count(n_); }
private:
  int n_;
};
template <typename T> T twice(T x) { return add(x, x); }
int Box::area(int k) { return k; }
}
"""
C_SHARP = """using System;
namespace App.Core {
  public class Store<T> : IStore where T : class {
    private int limit = 3;
    public string Name { get; set; }
    public Store(int n) : base(n) { Check(n); }
    public async Task<T> Put(T x) { return await Save(x); }
    public int Twice(int x) => Add(x, x);
  }
}
"""
PHP = """<?php
use App\\Base;
trait Loud { public function shout() { return strtoupper("}"); } }
class Store extends Base {
  private $limit = 3;
  public function put($x) { return $this->save($x); } # {
}
function run() { return new Store(); }
?>
<b>{</b>
"""
KOTLIN = """import a.b.C

data class Point(val x: Int) { fun norm(): Int { return abs(x) } }
object Single { val n = 3
  fun go() = run(n) }
fun <T> List<T>.second(): T = get(1)
"""
SWIFT = """import Foundation
struct Box { let n: Int
  init(n: Int) { self.n = n }
  func size() -> Int { return count(n) } }
extension Box { func twice<T>(_ x: T) throws -> T { return make(x) } }
"""
EXPECTED = {
    "javascript": (JAVASCRIPT, [("i", "", 0, 1, "", []), ("v", "", 2, 2, "", []), ("v", "", 3, 3, "", []), ("c", "Store", 6, 14, "check log save", [("s", "constructor", 8, 8, "check", []), ("s", "put", 9, 12, "log save", []), ("s", "name", 13, 13, "", [])]), ("s", "run", 15, 15, "Store go inner", [("s", "inner", 15, 15, "go", [])]), ("s", "add", 16, 16, "mul", []), ("s", "twice", 17, 17, "run", []), ("s", "", 18, 18, "", [])]),
    "typescript": (TYPESCRIPT, [("i", "", 0, 0, "", []), ("s", "Shape", 1, 1, "area", []), ("s", "Point", 2, 2, "", []), ("s", "Color", 3, 3, "", []), ("c", "Box", 4, 8, "Map fetch", [("s", "constructor", 6, 6, "", []), ("s", "get", 7, 7, "fetch", [])]), ("s", "load", 9, 9, "read", [])]),
    "java": (JAVA, [("i", "", 1, 1, "", []), ("c", "Store", 3, 14, "Oops Runnable check go save", [("v", "", 5, 5, "", []), ("s", "Store", 6, 6, "check", []), ("s", "put", 7, 12, "Oops Runnable go save", []), ("c", "Node", 13, 13, "", [("s", "get", 13, 13, "", [])])])]),
    "go": (GO, [("i", "", 2, 5, "", []), ("v", "", 7, 7, "", []), ("s", "Store", 9, 11, "", []), ("s", "Put", 13, 16, "Errorf check", []), ("s", "Map", 17, 17, "", [])]),
    "c": (C, [("i", "", 0, 0, "", []), ("v", "", 2, 2, "", []), ("s", "point", 3, 3, "", []), ("s", "add", 4, 7, "mul", []), ("s", "main", 8, 8, "add printf", [])]),
    "cpp": (CPP, [("i", "", 0, 0, "", []), ("c", "geo", 1, 12, "add count init_it", [("c", "Box", 2, 9, "count init_it", [("s", "Box", 4, 4, "init_it", []), ("s", "~Box", 5, 5, "", []), ("s", "size", 6, 6, "count", []), ("v", "", 8, 8, "", [])]), ("s", "twice", 10, 10, "add", []), ("s", "Box::area", 11, 11, "", [])])]),
    "c_sharp": (C_SHARP, [("i", "", 0, 0, "", []), ("c", "App.Core", 1, 9, "Add Check Save", [("c", "Store", 2, 8, "Add Check Save", [("v", "", 3, 3, "", []), ("s", "Name", 4, 4, "", []), ("s", "Store", 5, 5, "Check", []), ("s", "Put", 6, 6, "Save", []), ("s", "Twice", 7, 7, "Add", [])])])]),
    "php": (PHP, [("i", "", 1, 1, "", []), ("c", "Loud", 2, 2, "strtoupper", [("s", "shout", 2, 2, "strtoupper", [])]), ("c", "Store", 3, 6, "save", [("v", "", 4, 4, "", []), ("s", "put", 5, 5, "save", [])]), ("s", "run", 7, 7, "Store", [])]),
    "kotlin": (KOTLIN, [("i", "", 0, 0, "", []), ("c", "Point", 2, 2, "abs", [("s", "norm", 2, 2, "abs", [])]), ("c", "Single", 3, 4, "run", [("s", "go", 4, 4, "run", [])]), ("s", "second", 5, 5, "get", [])]),
    "swift": (SWIFT, [("i", "", 0, 0, "", []), ("c", "Box", 1, 3, "count", [("s", "init", 2, 2, "", []), ("s", "size", 3, 3, "count", [])]), ("c", "Box", 4, 4, "make", [("s", "twice", 4, 4, "make", [])])]),
}


@pytest.mark.parametrize("language", sorted(EXPECTED))
def test_trees_by_hand(language):
    source, expected = EXPECTED[language]
    assert outline(braces.parse(language, source)) == expected


@pytest.mark.parametrize("language", sorted(braces.PARSERS))
def test_broken_and_empty_files_do_not_stop(language):
    made = lambda text: [c["name"] for c in symbols.Chunker(text, "code", language).chunks(symbols.all_parsers())]
    opening = "<?php\n" if language == "php" else ""
    assert made(opening + "x = f(1, {\n") == ["chunk::0"] and made(opening + "a ) b") == ["chunk::0"]
    assert made("") == [] and made("\n \n") == []
    assert made("é" * 5000 + "\n" + "( " * 2000)[0] == "chunk::0"


def test_chunks_of_a_class_and_a_long_function():
    made = {c["name"]: c for c in symbols.Chunker(JAVA, "code", "java").chunks(symbols.all_parsers())}
    assert list(made) == ["[file_context]", "Store[context]", "Store.Store", "Store.put", "Store.Node[context]", "Store.Node.get"]
    assert made["Store.put"]["text"].startswith("# context: inside Store\n    @Override") and made["Store.put"]["raw"] == ["Oops", "Runnable", "go", "save"]
    assert made["[file_context]"]["symbol_names"][:1] == ["Store"] and made["Store.put"]["parent"] == "Store" and made["Store.put"]["start_line"] == 7
    long = "function big() {\n" + "".join(f"  function part{i}() {{\n    return call{i}(1);\n  }}\n" for i in range(100)) + "}\n"
    names = [c["name"] for c in symbols.Chunker(long, "code", "javascript").chunks(symbols.all_parsers())]
    assert names[:3] == ["[file_context]", "big[header]", "big.part0"] and names[-1] == "big.part99"


@pytest.mark.parametrize("language, code", [("javascript", 'function long() {\n  return words("%s");\n}\n'), ("go", 'func long() string {\n\treturn words("%s")\n}\n')])
def test_a_long_symbol_is_a_chunk_too(language, code):
    text = code % ("x" * 4000)
    made = {c["name"]: c for c in symbols.Chunker(text, "code", language).chunks(symbols.all_parsers())}
    assert made["long"]["text"] == text.strip()
    assert "long" not in {c["name"] for c in symbols.Chunker(text, "code", language, keep_long=False).chunks(symbols.all_parsers())}


def test_every_symbol_and_context_of_every_document_as_in_sql(spark, tmp_path):
    """Sizes around the limits of a symbol and of a file's context, many lines, no text."""
    sized = lambda n, more: "\n".join(["x" * n, *["b"] * more])
    rows = [*((3 * j + k, sized(n, 1)) for j, n in enumerate([*range(1480, 1560), *range(3150, 3170)]) for k in range(3)), *((900 + k, sized(1, m)) for k, m in enumerate([300, 300, 300, 0, 0, 0, 87, 88, 89])), (990, None), (991, None), (992, "")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    named = "path name parent language start_line calls".split()
    theirs = sorted(db.execute(f"SELECT {', '.join(named)} FROM ({__spark_entry__.oracle_sql()['symbols_of_other_languages']})").fetchall())
    mine = sorted(tuple(r) for r in __spark_entry__.queries()["symbols_of_other_languages"](spark, str(tmp_path)).select(*named).collect())
    assert mine == theirs and {r[0] for r in mine} == {f"s/m{i}{('.js', '.java', '.go')[i % 3]}" for i, _ in rows}

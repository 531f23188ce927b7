"""Queries of the line patterns and full readers of TypeScript, JavaScript and Go, over one small file made of each customer or part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import architecture, languages, parse, resolve
from ..operators.graph import CodeGraph
from .registry import query, spread, table


def _sources(spark, sf_dir, name: str, key: str, folder: str, suffix: str, language: str, text: str):
    """One file for each row of a table: text with ~ for its key."""
    k = F.col(key).cast("string")
    return spread(table(spark, sf_dir, name).select(key)).select(F.concat(F.lit(f"{folder}/{language[0]}"), k, F.lit(suffix)).alias("path"), F.lit(language).alias("language"), F.replace(F.lit(text), F.lit("~"), k).alias("source"))


def _rows(name: str, key: str, folder: str, suffix: str, language: str, values: str, columns: str) -> str:
    """SQL of one row for each row of a table and each of some values, with ~ for the key."""
    names = columns.split(", ")
    each = ", ".join(f"replace({c}, '~', cast({key} as varchar)) as {c}" if c in ("id", "name", "signature", "docstring", "parent", "module", "symbols", "alias", "detail") else c for c in names)
    return f"select '{folder}/{language[0]}' || {key} || '{suffix}' as path, {each} from {name} cross join (values {values}) v({columns})"


_TS = """import def~ from './m~';
import { one as uno, two } from "../lib/n~";
import * as all from 'pkg~';
import type { T~ } from './types';
import './side~';

/**
 * Does ~.
 */
export async function run~(a: number) {
  const s = "} {";
  if (a) { return `}${a}`; }
}

export abstract class Box~ {
  size = 1; // }
}

interface I~ { a: number }
export type Y~ = string;
export const enum E~ { A }
export const arrow~ = (x: number): number => {
  return x;
};
const inner = function () { return 1; };
export { inner, I~ as J };
export default Box~;
export { gone as away } from './other~';
"""
_TS_PATH = ("customer", "c_custkey", "web", ".tsx", "typescript")
#: The last line of a chunk of the patterns lies before the next chunk.
_TS_CHUNKS = _rows(*_TS_PATH, """('function','run~','export async function run~(a: number)',10,13,true,'Does ~.'), ('class','Box~','export abstract class Box~',15,16,true,null),
  ('interface','I~','interface I~',19,19,false,null), ('type','Y~','export type Y~ = string;',20,21,true,null), ('function','arrow~','export const arrow~ = (x: number): number =>',22,24,true,null), ('function','inner','const inner = function ()',25,25,false,null)""",
    "type, name, signature, start_line, end_line, exported, docstring")
_TS_IMPORTS = _rows(*_TS_PATH, "('./m~','def~','',1,true), ('../lib/n~','one,two','',2,true), ('pkg~','','all',3,false), ('./side~','','',5,true)", "module, symbols, alias, line, is_relative")


def _ts(spark, sf_dir):
    return _sources(spark, sf_dir, *_TS_PATH, _TS)


def _plain(df, *columns):
    return df.select("path", *columns)


@query(_TS_CHUNKS)
def ts_chunks(spark, sf_dir):
    return _plain(parse.chunks(_ts(spark, sf_dir)), "type", "name", "signature", "start_line", "end_line", "exported", "docstring")


@query(_TS_IMPORTS)
def ts_imports(spark, sf_dir):
    return _plain(parse.imports(_ts(spark, sf_dir)), "module", F.array_join("symbols", ",").alias("symbols"), F.coalesce("alias", F.lit("")).alias("alias"), "line", "is_relative")


@query(_rows(*_TS_PATH, """('function','run~',10,13,true,'{"is_async": true}'), ('class','Box~',15,17,true,'{"is_abstract": true}'), ('interface','I~',19,19,false,'{}'),
  ('type','Y~',20,21,true,'{}'), ('enum','E~',21,21,true,'{}'), ('function','arrow~',22,24,true,'{}'), ('function','inner',25,25,false,'{}')""", "type, name, start_line, end_line, exported, detail"))  # fmt: skip
def ts_reader_chunks(spark, sf_dir):
    c = languages.chunks(languages.parsed(_ts(spark, sf_dir)))
    return _plain(c, "type", "name", "start_line", "end_line", "exported", F.col("metadata").alias("detail"))


@query(_rows(*_TS_PATH, "('./m~','def~','',1,false), ('../lib/n~','one,two','',2,false), ('pkg~','','all',3,false), ('./types','T~','',4,true), ('./side~','','',5,false), ('./other~','gone','',28,false)", "module, symbols, alias, line, is_type_only"))
def ts_reader_imports(spark, sf_dir):
    i = languages.imports(languages.parsed(_ts(spark, sf_dir)))
    return _plain(i, "module", F.array_join("symbols", ",").alias("symbols"), F.coalesce("alias", F.lit("")).alias("alias"), "line", "is_type_only")


@query(_rows(*_TS_PATH, "('run~','function',10,false), ('Box~','class',15,false), ('Y~','type',20,false), ('E~','enum',21,false), ('arrow~','function',22,false), ('inner','unknown',26,false), ('I~','unknown',26,false), ('Box~','unknown',27,true), ('gone','re-export',28,false)", "name, type, line, is_default"))
def ts_reader_exports(spark, sf_dir):
    return _plain(languages.exports(languages.parsed(_ts(spark, sf_dir))), "name", "type", "line", "is_default")


_JS = """import lib~ from 'lib';
function plain~(a) {
  return { a };
}
class Old~ { }
export const view~ = () => <div/>;
var late = async function () {
};
"""
_JS_PATH = ("supplier", "s_suppkey", "app", ".jsx", "javascript")


@query(_rows(*_JS_PATH, "('function','plain~',2,4,false), ('class','Old~',5,5,false), ('function','view~',6,6,true), ('function','late',7,8,false)", "type, name, start_line, end_line, exported"))
def js_chunks(spark, sf_dir):
    return _plain(parse.chunks(_sources(spark, sf_dir, *_JS_PATH, _JS)), "type", "name", "start_line", "end_line", "exported")


@query(_rows(*_JS_PATH, """('function','plain~',2,'{}'), ('class','Old~',5,'{}'), ('function','view~',6,'{"is_component": true}'), ('function','late',7,'{"is_async": true}')""", "type, name, start_line, detail"))
def js_reader_chunks(spark, sf_dir):
    return _plain(languages.chunks(languages.parsed(_sources(spark, sf_dir, *_JS_PATH, _JS))), "type", "name", "start_line", F.col("metadata").alias("detail"))


_GO = """package shop

import "fmt"
import short "net/~"
import (
	"os"
	_ "driver/~"
	long "path/~"
)

// Cart holds ~.
// And more.
type Cart struct {
	Items int
	name  string
}

type Buyer interface {
	Buy() error
}

type Alias~ = Cart

func (c *Cart) Add~(n int) (int, error) {
	s := "}"
	return n, nil
}

func helper(a string) string {
	return a
}
"""
_GO_PATH = ("part", "p_partkey", "shop", ".go", "go")


def _go(spark, sf_dir):
    return _sources(spark, sf_dir, *_GO_PATH, _GO)


@query(_rows(*_GO_PATH, "('struct','Cart','type Cart struct',13,16,true,'Cart holds ~.\nAnd more.'), ('interface','Buyer','type Buyer interface',18,20,true,null), ('method','Add~','func (c *Cart) Add~(n int) (int, error)',24,27,true,null), ('function','helper','func helper(a string) string',29,31,false,null)", "type, name, signature, start_line, end_line, exported, docstring"))
def go_chunks(spark, sf_dir):
    return _plain(parse.chunks(_go(spark, sf_dir)), "type", "name", "signature", "start_line", "end_line", "exported", "docstring")


@query(_rows(*_GO_PATH, "('fmt','',3), ('net/~','short',4), ('os','',6), ('driver/~','_',7), ('path/~','long',8)", "module, alias, line"))
def go_imports(spark, sf_dir):
    return _plain(parse.imports(_go(spark, sf_dir)), "module", F.coalesce("alias", F.lit("")).alias("alias"), "line")


@query(_rows(*_GO_PATH, """('struct','Cart',16,'{"fields": ["Items int", "name  string"], "package": "shop"}'), ('interface','Buyer',20,'{"package": "shop"}'), ('type','Alias~',22,'{"alias_target": "Cart", "package": "shop"}'),
  ('method','Add~',27,'{"package": "shop", "params": "n int", "receiver_name": "c", "receiver_type": "*Cart", "returns": "int, error"}'), ('function','helper',31,'{"package": "shop", "params": "a string", "returns": "string"}')""", "type, name, end_line, detail"))  # fmt: skip
def go_reader_chunks(spark, sf_dir):
    return _plain(languages.chunks(languages.parsed(_go(spark, sf_dir))), "type", "name", "end_line", F.col("metadata").alias("detail"))


@query(_rows(*_GO_PATH, "('fmt','',3,false), ('net/~','short',4,false), ('os','',6,false), ('driver/~','',7,true), ('path/~','long',8,false)", "module, alias, line, is_type_only"))
def go_reader_imports(spark, sf_dir):
    return _plain(languages.imports(languages.parsed(_go(spark, sf_dir))), "module", F.coalesce("alias", F.lit("")).alias("alias"), "line", "is_type_only")


_PY = """import os, sys as system
from .near import one as uno, two
__all__ = ["Base~", "work"]

@wraps(1)
@pkg.mark
class Base~(Top, Other):
    '''Base ~.'''

    async def go(self, n: int = 1) -> int:
        return n

def work(a,
         b):
    pass

def _hidden(): return 1
"""
_PY_PATH = ("customer", "c_custkey", "py", ".py", "python")


def _py(spark, sf_dir):
    return _sources(spark, sf_dir, *_PY_PATH, _PY)


@query(_rows(*_PY_PATH, """('class','Base~','class Base~(Top, Other)',7,11,true,'Base ~.','','{"bases": "Top, Other", "decorators": ["wraps", "pkg.mark"]}'),
  ('method','go','async def go(self, n: int = 1) -> int',10,11,false,null,'py/p~.py:7:class:Base~','{"decorators": [], "is_async": true, "params": "self, n: int = 1", "return_type": "int"}'),
  ('function','work','def work(a,\n         b)',13,15,true,null,'','{"decorators": [], "is_async": false, "params": "a,\\n         b", "return_type": null}'),
  ('function','_hidden','def _hidden()',17,17,false,null,'','{"decorators": [], "is_async": false, "params": "", "return_type": null}')""", "type, name, signature, start_line, end_line, exported, docstring, parent, detail"))  # fmt: skip
def py_reader_chunks(spark, sf_dir):
    c = languages.chunks(languages.parsed(_py(spark, sf_dir)))
    return _plain(c, "type", "name", "signature", "start_line", "end_line", "exported", "docstring", F.coalesce("parent", F.lit("")).alias("parent"), F.col("metadata").alias("detail"))


@query(_rows(*_PY_PATH, "('os','','',1,false), ('sys','','system',1,false), ('.near','one,two','',2,true)", "module, symbols, alias, line, is_relative"))
def py_reader_imports(spark, sf_dir):
    i = languages.imports(languages.parsed(_py(spark, sf_dir)))
    return _plain(i, "module", F.array_join("symbols", ",").alias("symbols"), F.coalesce("alias", F.lit("")).alias("alias"), "line", "is_relative")


@query(_rows(*_PY_PATH, "('Base~','class',7), ('work','function',13)", "name, type, line"))
def py_reader_exports(spark, sf_dir):
    return _plain(languages.exports(languages.parsed(_py(spark, sf_dir))), "name", "type", "line")


@query("select 'customer' as kind, count(*) * 4 as chunks, cast(count(*) * 11 as bigint) as line_count, cast(count(*) * 440 as bigint) as char_count from customer")
def reader_sizes(spark, sf_dir):
    c = languages.sizes(languages.chunks(languages.parsed(_py(spark, sf_dir))))
    return c.agg(F.lit("customer").alias("kind"), F.count(F.lit(1)).alias("chunks"), F.sum("line_count").alias("line_count"), F.sum("char_count").alias("char_count"))


# relative imports: each customer is a module of its nation and imports the next one there, a helper above and itself by name

_REL = """f as (select 'pkg/' || c_nationkey || '/c' || c_custkey || '.ts' as path, c_nationkey as n, c_custkey as k, lead(c_custkey) over (partition by c_nationkey order by c_custkey) as nxt from customer),
r as (select path, './c' || nxt as module, 'pkg/' || n || '/c' || nxt || '.ts' as target from f where nxt is not null
  union all select path, '../util', 'pkg/util.ts' from f union all select path, '../' || n || '/c' || k, path from f union all select path, './nowhere', null from f)"""


@query(f"with {_REL} select path, module, target from r")
def relative_imports(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("n"), F.col("c_custkey").alias("k"))
    nxt = F.lead("k").over(Window.partitionBy("n").orderBy("k"))
    name = lambda k: F.concat(F.lit("/c"), k.cast("string"))
    f = c.withColumns({"path": F.concat(F.lit("pkg/"), "n", name(F.col("k")), F.lit(".ts")), "nxt": nxt})
    modules = F.array(F.concat(F.lit("."), name(F.col("nxt"))), F.lit("../util"), F.concat(F.lit("../"), "n", name(F.col("k"))), F.lit("./nowhere"))
    rows = f.select("path", F.explode(modules).alias("module")).filter("module is not null").withColumn("is_relative", F.lit(True)).withColumn("language", F.lit("typescript"))
    files = f.select("path").union(spark.createDataFrame([("pkg/util.ts",)], "path string"))
    return resolve.resolve(rows, files).select("path", "module", "target")


# the second pass over imports: no name tells a layer, and every key has one dependency at most

_SETTLED = """e as (select distinct 'k' || lpad(cast(o_orderkey as varchar), 9, '0') as src, 'k' || lpad(cast(o_custkey as varchar), 9, '0') as dst from orders),
n as (select src as id from e union select dst from e),
found as (select id, 4 as k from n where id not in (select src from e) union all select src, 2 from e where dst >= src
  union all select e.src, least(found.k + 1, 4) from found join e on e.dst = found.id and e.dst < e.src)"""


@query(f"with recursive {_SETTLED} select id, case k when 0 then 'presentation' when 1 then 'application' when 2 then 'domain' when 3 then 'infrastructure' else 'shared' end as layer, 'imports' as method from found")
def imports_layers(spark, sf_dir):
    name = lambda c: F.concat(F.lit("k"), F.lpad(F.col(c).cast("string"), 9, "0"))
    edges = table(spark, sf_dir, "orders").select(name("o_orderkey").alias("src"), name("o_custkey").alias("dst"))
    return architecture.classify(CodeGraph.of(edges).kept()).select("id", "layer", "method")

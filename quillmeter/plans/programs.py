"""Source files derived from the documents, a program of one of 18 languages each, and what is declared in them, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X

#: language, ending, text before the body, a line of the body, text after it, and declarations: name, kind, parent, start, end.
#: A start or end is a pair (a, b): line a + b * k in a program whose body has k lines.
PROGRAMS = (
    ("python", ".py", "LIMIT = 3\n\n\nclass Box:\n    def get(self, x):\n", "        x = x + 1\n", "        return x\n\n\nasync def run():\n    return Box()\n", (("LIMIT", "const", None, (1, 0), (1, 0)), ("Box", "class", None, (4, 0), (6, 1)), ("get", "method", "Box", (5, 0), (6, 1)), ("run", "function", None, (9, 1), (10, 1)))),
    ("typescript", ".ts", "export class Box {\n  run(x: number): number {\n", "    x = x + 1;\n", "    return x;\n  }\n}\n\nexport function make() {\n  return 1;\n}\n", (("Box", "class", None, (1, 0), (5, 1)), ("run", "method", "Box", (2, 0), (4, 1)), ("make", "function", None, (7, 1), (9, 1)))),
    ("javascript", ".js", "export function run(x) {\n", "  x = x + 1;\n", "  return x;\n}\n", (("run", "function", None, (1, 0), (3, 1)),)),
    ("go", ".go", "package main\n\nfunc run(n int) int {\n", "\tn = n + 1\n", "\treturn n\n}\n", (("run", "function", None, (3, 0), (5, 1)),)),
    ("rust", ".rs", "pub fn run(x: i32) -> i32 {\n", "    let x = x + 1;\n", "    x\n}\n\npub struct Box1 {\n    x: i32,\n}\n", (("run", "function", None, (1, 0), (3, 1)), ("Box1", "struct", None, (5, 1), (7, 1)))),
    ("java", ".java", "public class Box {\n    public int run(int x) {\n", "        x = x + 1;\n", "        return x;\n    }\n}\n", (("Box", "class", None, (1, 0), (5, 1)), ("run", "method", "Box", (2, 0), (4, 1)))),
    ("csharp", ".cs", "public class Box {\n    public int Run(int x) {\n", "        x = x + 1;\n", "        return x;\n    }\n}\n", (("Box", "class", None, (1, 0), (5, 1)), ("Run", "method", "Box", (2, 0), (4, 1)))),
    ("ruby", ".rb", "module Box\n  def run(x)\n", "    x += 1\n", "    x\n  end\nend\n", (("Box", "module", None, (1, 0), (5, 1)), ("run", "method", "Box", (2, 0), (4, 1)))),
    ("php", ".php", "<?php\nclass Box {\n    public function run($x) {\n", "        $x = $x + 1;\n", "        return $x;\n    }\n}\n", (("Box", "class", None, (2, 0), (6, 1)), ("run", "method", "Box", (3, 0), (5, 1)))),
    ("bash", ".sh", "run() {\n", "  x=1\n", "}\n", (("run", "function", None, (1, 0), (2, 1)),)),
    ("sql", ".sql", "CREATE TABLE box (\n", "  a INT,\n", "  b INT\n);\n", (("box", "table", None, (1, 0), (2, 1)),)),
    ("terraform", ".tf", 'resource "kind" "box" {\n', "  a = 1\n", "}\n", (("kind.box", "resource", None, (1, 0), (2, 1)),)),
    ("kotlin", ".kt", "class Box {\n    fun run(x: Int): Int {\n", "        val y = x + 1\n", "        return x\n    }\n}\n", (("Box", "class", None, (1, 0), (5, 1)), ("run", "method", "Box", (2, 0), (4, 1)))),
    ("swift", ".swift", "class Box {\n    func run(x: Int) -> Int {\n", "        let y = x + 1\n", "        return x\n    }\n}\n", (("Box", "class", None, (1, 0), (5, 1)), ("run", "method", "Box", (2, 0), (4, 1)))),
    ("c", ".c", "int run(int x) {\n", "    x = x + 1;\n", "    return x;\n}\n", (("run", "function", None, (1, 0), (3, 1)),)),
    ("cpp", ".cpp", "class Box {\n};\n\nint run(int x) {\n", "    x = x + 1;\n", "    return x;\n}\n", (("Box", "class", None, (1, 0), (2, 0)), ("run", "function", None, (4, 0), (6, 1)))),
    ("scala", ".scala", "object Box {\n  def run(x: Int): Int = {\n", "    val y = x + 1\n", "    x\n  }\n}\n", (("Box", "object", None, (1, 0), (5, 1)), ("run", "method", "Box", (2, 0), (4, 1)))),
    ("markdown", ".md", "# Title\n\n", "text\n", "\n## run\n\nmore\n", (("Title", "h1", None, (1, 0), (7, 1)), ("run", "h2", "Title", (4, 1), (7, 1)))),
)
SELECTORS = ("Box.run", "run", "RUN")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document, its language by the id and the length of its body by the text's: path, text."""
    d = X.documents(spark, sf_dir).select("doc_id", (F.length("text") % 7 + 1).alias("k"), F.pmod("doc_id", F.lit(len(PROGRAMS))).alias("n"))
    pick = lambda j: F.get(F.array(*(F.lit(p[j]) for p in PROGRAMS)), F.col("n").cast("int"))
    return d.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), pick(1)).alias("path"), F.concat(pick(2), F.repeat(pick(3), F.col("k")), pick(4)).alias("text"))


def selectors(sources: DataFrame) -> DataFrame:
    """For each file one of three ways to ask for its declaration run."""
    n = F.regexp_extract("path", "[0-9]+", 0).cast("long")
    return sources.select("path", F.get(F.array(*map(F.lit, SELECTORS)), F.pmod(n, F.lit(len(SELECTORS))).cast("int")).alias("selector"))


def _text(s: str) -> str:
    out = "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    return f"({out})"


def _null(s: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if s is None else f"'{s}'"


_FILES = ", ".join(f"({n}, '{p[0]}', '{p[1]}', {_text(p[2])}, {_text(p[3])}, {_text(p[4])})" for n, p in enumerate(PROGRAMS))
_NAMES = ", ".join(f"({n}, '{name}', '{kind}', {_null(parent)}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for n, p in enumerate(PROGRAMS) for name, kind, parent, a, b in p[5])
#: CTEs: pf (path, language, text) and ps, its declarations (path, language, name, kind, start, stop, parent, qualname, selector).
CTES = f"""pl(n, language, ending, h, b, t) AS (VALUES {_FILES}), pn(n, name, kind, parent, a0, a1, b0, b1) AS (VALUES {_NAMES}),
pd AS (SELECT doc_id, length(coalesce(text, '')) % 7 + 1 AS k, doc_id % {len(PROGRAMS)} AS n FROM documents),
pf AS (SELECT doc_id, 'src/' || CAST(doc_id AS VARCHAR) || ending AS path, language, h || repeat(b, CAST(k AS BIGINT)) || t AS text FROM pd JOIN pl USING (n)),
ps AS (SELECT 'src/' || CAST(doc_id AS VARCHAR) || ending AS path, language, name, kind, CAST(a0 + a1 * k AS INT) AS start, CAST(b0 + b1 * k AS INT) AS stop, parent, CASE WHEN parent IS NULL THEN name ELSE parent || '.' || name END AS qualname,
 ['Box.run', 'run', 'RUN'][CAST(doc_id % 3 AS INT) + 1] AS selector FROM pd JOIN pl USING (n) JOIN pn USING (n))"""
#: The declarations that the selectors name.
CHOSEN = "pc AS (SELECT * FROM ps WHERE CASE selector WHEN 'Box.run' THEN qualname = 'Box.run' ELSE lower(name) = 'run' END)"

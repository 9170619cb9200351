"""Tables of files made from the given tables, by SQL text that Spark and the checking engine both run."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from srcatlas.session import spread
from srcatlas.sources.fs import remove_file, write_bytes

# Documents as files: line feeds doubled, so each line is a paragraph.
DOCS_SQL = """
select source as repo, lang || '/doc_' || cast(doc_id as varchar(20)) ||
  case doc_id % 4 when 0 then '.py' when 1 then '.go' when 2 then '.js' else '.md' end as path,
  replace(text, chr(10), chr(10) || chr(10)) as content
from documents
"""

# Documents as they are: one paragraph each.
RAW_DOCS_SQL = """
select source as repo, lang || '/doc_' || cast(doc_id as varchar(20)) || '.md' as path, text as content
from documents
"""

# Pages as files.
PAGES_SQL = """
select 'site' || cast(page_id % 7 as varchar(20)) as repo,
  'p/' || cast(page_id as varchar(20)) || '.html' as path,
  replace(html, '>', '>' || chr(10)) as content
from pages
"""

# A code corpus with imports, telling patterns, several languages and references between files.
CODE_SQL = """
with b as (
  select p_partkey as k, p_name as nm, p_size as sz,
         p_partkey % 5 as d, cast(floor(p_partkey / 5) as bigint) % 7 as e,
         'm' || cast(p_partkey as varchar(20)) as me,
         'm' || cast((p_partkey * 13 + 4) % 200 as varchar(20)) as dep,
         'M' || cast(p_partkey as varchar(20)) as cls, chr(10) as nl
  from part)
select 'r' || cast(k % 4 as varchar(20)) as repo,
  case d when 0 then 'cmd/' when 1 then 'internal/api/' when 2 then 'core/model/' when 3 then 'util/' else '' end
  || me ||
  case e when 0 then '.go' when 1 then '.py' when 2 then '.ts' when 3 then '.js' when 4 then '.java' when 5 then '.tsx' else '.txt' end as path,
  case e
   when 0 then 'package x' || nl || nl || 'import "' || dep || '"' || nl || nl || 'type ' || cls || ' interface {' || nl || '}' || nl || nl || 'func main() {' || nl || '  // ' || nm || nl || '}' || nl
   when 1 then 'import os' || nl || 'from ' || dep || ' import y' || nl || nl || 'class ' || cls || ':' || nl || '    def __init__(self):' || nl || '        pass' || nl || nl || 'if __name__ == "__main__":' || nl || '    pass' || nl
   when 2 then 'import { a } from "./' || dep || '"' || nl || nl || 'export default class ' || cls || ' {' || nl || '}' || nl
   when 3 then 'const a = require("./' || dep || '")' || nl || nl || nl || 'class ' || cls || ' {}' || nl
   when 4 then 'import a.' || dep || ';' || nl || nl || 'public abstract class ' || cls || ' {' || nl || '  public static void main(String[] a) {}' || nl || '}' || nl
   when 5 then 'import { a } from "./' || dep || '"' || nl
   else nm || nl end
  || nl || repeat('  ' || nm || nl, sz) as content
from b
"""

# Files whose names hold hyphens, dots and blanks, or nothing before the extension, with references between them.
NAMES_SQL = """
with b as (
  select p_partkey as k, p_name as nm, cast(p_partkey as varchar(20)) as me,
         cast((p_partkey * 13 + 4) % 200 as varchar(20)) as other, cast(p_partkey % 50 as varchar(20)) as near, chr(10) as nl
  from part)
select 'n' || cast(k % 3 as varchar(20)) as repo,
  case k % 6 when 0 then 'web/user-m' || me || '.ts' when 1 then 'm' || me || '.test.js' when 2 then 'doc/my m' || me || '.md'
    when 3 then 'm' || me || '.go' when 4 then 'a.b-c_' || me || '.d.ts' else 'd' || me || '/.py' end as path,
  'import "./user-m' || other || '"; m' || near || '.test, my m' || other || nl || 'a.b-c_' || near || '.d (m' || other || ') ' || nm as content
from b
"""

# Documents under names with a word of their own and a hyphen, an en dash or a blank.
NAMED_DOCS_SQL = """
select source as repo, lang || '/' || left(text, 2) || case doc_id % 3 when 0 then ' ' when 1 then '-' else '–' end
  || substring(text, 4, 1) || '/' || left(text, 3) || '.' || cast(doc_id as varchar(20)) as path, text as content
from documents
"""

# Manifests: four parts make a repository with one of each kind and a program; in every fifth repository
# they lie in a subdirectory, where they do not count.
MANIFESTS_SQL = """
with b as (
  select p_partkey as k, cast(floor(p_partkey / 4) as bigint) as j, replace(p_name, ' ', '_') as nm,
         lower(replace(p_brand, '#', '-')) as br, cast(p_size as varchar(20)) as sz, chr(10) as nl, chr(9) as tab,
         chr(34) as q
  from part)
select 'pkg' || cast(j as varchar(20)) as repo,
  case when j % 5 = 0 then 'sub/' else '' end ||
  case k % 4 when 0 then 'go.mod' when 1 then 'package.json' when 2 then 'requirements.txt' else 'run.py' end as path,
  case k % 4
   when 0 then 'module ex.org/' || nm || nl || nl || 'go 1.' || sz || nl || nl || 'require (' || nl || tab || 'ex.org/'
     || nm || ' v1.' || sz || nl || tab || 'ex.org/' || br || ' v0.1 // indirect' || nl || ')' || nl
   when 1 then '{' || nl || '  ' || q || 'name' || q || ': ' || q || nm || q || ',' || nl || nl || '  ' || q || 'dependencies' || q
     || ': {' || nl || '    ' || q || nm || q || ': ' || q || '^1.' || sz || q || ',' || nl || '    ' || q || br || q || ': '
     || q || '>=1 <2' || q || nl || '  }'
     || case when j % 3 = 0 then '' else ',' || nl || nl || '  ' || q || 'devDependencies' || q || ' : {' || nl || '    ' || q
     || 'dev-' || br || q || ': ' || q || sz || ', 9' || q || nl || '  }' end || nl || '}' || nl
   when 2 then '# pinned' || nl || nm || '==1.' || sz || nl || nl || '  ' || br || '  ' || nl || tab || '#' || nm || nl
   else 'import ' || nm || nl end as content
from b
"""

# File versions from events: a file is a user, a kind of event and a property.
FILE_VERSIONS_SQL = """
select 'u' || cast(user_id % 10 as varchar(20)) as repo,
  cast(user_id as varchar(20)) || '/' || event_type || '/' || props as path, ts as mtime
from events
"""

# Versions of documents for the stream: fifty files per source and language; some versions delete.
DOC_VERSIONS_SQL = """
select source as repo, lang || '/f' || cast(doc_id % 50 as varchar(20)) || '.md' as path, doc_id as version,
  case when doc_id % 7 = 3 then null else replace(text, chr(10), chr(10) || chr(10)) end as content
from documents
"""

# Conversations as an index without vectors: a turn is a chunk.
TURNS_SQL = """
select 'talk' || cast(conv_id % 5 as varchar(20)) as repo, 'c' || cast(conv_id as varchar(20)) as file,
  cast(turn as int) as chunk_idx, text as content
from conversations
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the texts above over the tables of ``sf_dir``."""
    tables = [t for t in ("documents", "pages", "part", "events", "conversations") if f"from {t}" in sql]
    frames = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in tables}
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of the text itself, for the SQL formatter
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(sql, **frames)


def write_as_files(files: DataFrame, folder: str) -> None:
    """Write a table of files below ``folder/<repo>/``, from the executors."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, path, content in zip(*(batch[c].to_pylist() for c in ("repo", "path", "content"))):
                write_bytes(f"{folder}/{repo}/{path}", content.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    files.select("repo", "path", "content").mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()


def remove_files(files: DataFrame, folder: str) -> None:
    """Remove files that ``write_as_files`` wrote, from the executors."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                remove_file(f"{folder}/{row['repo']}/{row['path']}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    files.select("repo", "path").mapInArrow(drop, "n bigint").write.format("noop").mode("overwrite").save()

"""Files a main text refers to, and imports that point into the bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.functions.paths import slashes
from riskloom.packs.loader import java_regex, literal_need

# The forms a reference takes; group 1 is the path.
PATTERNS = (
    r"\[.*?\]\(([^)]+)\)",
    r"""(?i)(?:see|refer to|check|read)\s+[`"']?(\S+\.\w+)[`"']?""",
    r"(?i)(?:run|execute|invoke)\s+(scripts/\S+)",
    r"@reference:\s*(.+)",
    r"(?i)(?:include|import|load):\s*(.+)",
)
IMPORT = r"(?m)^(?:from\s+(\S+)\s+)?import\s+(\S+)"

# Modules of the standard library, older releases' included, that are never a bundle's own module.
STDLIB = tuple(
    "__future__ _thread abc aifc argparse array ast asynchat asyncio asyncore atexit base64 bdb binascii binhex bisect "
    "builtins calendar cgi cgitb chunk cmath cmd code codecs codeop collections colorsys compileall concurrent "
    "configparser contextlib contextvars copy copyreg cProfile crypt csv ctypes curses dataclasses datetime dbm decimal "
    "difflib dis distutils doctest email encodings enum errno faulthandler fcntl filecmp fileinput fnmatch fractions "
    "ftplib functools gc getopt getpass gettext glob grp gzip hashlib heapq hmac html http idlelib imaplib imghdr imp "
    "importlib inspect io ipaddress itertools json keyword lib2to3 linecache locale logging lzma mailbox mailcap marshal "
    "math mimetypes mmap modulefinder multiprocessing netrc nis nntplib numbers operator optparse os ossaudiodev pathlib "
    "pdb pickle pickletools pipes pkgutil platform plistlib poplib posix posixpath pprint profile pstats pty pwd "
    "py_compile pyclbr pydoc queue quopri random re readline reprlib resource rlcompleter runpy sched secrets select "
    "selectors shelve shlex shutil signal site smtpd smtplib sndhdr socket socketserver sqlite3 ssl stat statistics "
    "string stringprep struct subprocess sunau symtable sys sysconfig syslog tabnanny tarfile telnetlib tempfile termios "
    "test textwrap threading time timeit tkinter token tokenize tomllib trace traceback tracemalloc tty turtle turtledemo "
    "types typing unicodedata unittest urllib venv warnings wave weakref webbrowser winreg winsound wsgiref xdrlib xml "
    "xmlrpc zipapp zipfile zipimport zlib typing_extensions".split()
)
# Well-known packages that are never a bundle's own module.
THIRD_PARTY = tuple(
    "pip setuptools wheel virtualenv tox nox flask django fastapi starlette bottle tornado sanic quart aiohttp "
    "falcon pyramid requests httpx urllib3 httplib2 pycurl websocket paramiko fabric numpy pandas scipy polars "
    "dask xarray statsmodels sympy matplotlib seaborn plotly bokeh altair torch tensorflow keras scikit_learn "
    "sklearn transformers huggingface_hub openai anthropic langchain llamaindex tiktoken sqlalchemy psycopg2 "
    "pymysql aiomysql asyncpg motor pymongo redis aioredis peewee databases tortoise dynamodb alembic pony "
    "sqlmodel pytest nose hypothesis faker factory_boy responses vcrpy flake8 pylint mypy black isort ruff bandit "
    "safety pyflakes pycodestyle pydantic marshmallow cerberus voluptuous dataclasses_json attrs cattrs click "
    "typer argcomplete structlog loguru sentry_sdk datadog python_dotenv pydantic_settings dynaconf watchdog "
    "pyinotify psutil pathlib2 pyfakefs cryptography pyjwt jose passlib bcrypt cffi pyopenssl email_validator "
    "yagmail pillow opencv_python imageio celery rq dramatiq huey arq rich colorama tqdm tabulate prettytable "
    "jinja2 mako chardet python_dateutil pytz dateutil deprecated".split()
)


def is_local_reference(path: Column) -> Column:
    return (
        (path != "")
        & ~path.rlike(r"^(?:https?://|ftp://|#|/)")
        & ~F.contains(path, F.lit(".."))
    )


def extracted_paths(content: Column) -> Column:
    """Sorted distinct local references of a text."""
    folded = T.folded(content)
    nothing = F.array().cast("array<string>")
    found = F.concat(*[
        F.when(T.holds(folded, literal_need(p)), F.regexp_extract_all(content, F.lit(java_regex(p)), 1)).otherwise(nothing)
        for p in PATTERNS
    ])
    trimmed = F.transform(found, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.array_sort(F.array_distinct(F.filter(trimmed, is_local_reference)))


def references(files: DataFrame) -> DataFrame:
    """(bundle_id, rel_path, reference), one row each; row-wise, no exchange."""
    rows = files.select("bundle_id", "rel_path", F.explode_outer(extracted_paths(T.unix_breaks(F.col("content")))).alias("reference"))
    return rows.where(F.col("reference").isNotNull())


def imports(files: DataFrame) -> DataFrame:
    """Top-level module names imported by a text, library names left out."""
    source = F.regexp_extract_all("content", F.lit("(?dU)" + IMPORT), 1)
    target = F.regexp_extract_all("content", F.lit("(?dU)" + IMPORT), 2)
    names = F.zip_with(source, target, lambda a, b: F.split(F.when(a != "", a).otherwise(b), r"\.", 2)[0])
    known = F.array(*[F.lit(m) for m in STDLIB + THIRD_PARTY])
    own = F.array_except(F.array_distinct(names), known)
    rows = files.where(F.contains("content", F.lit("import"))).select(
        "bundle_id", "rel_path", F.explode_outer(own).alias("module")
    )
    return rows.where(F.col("module").isNotNull())


def local_modules(files: DataFrame) -> DataFrame:
    """Imports that resolve to a file of the bundle: module.py or module/__init__.py."""
    wanted = imports(files).select(
        "bundle_id", "rel_path",
        F.explode(F.array(F.concat("module", F.lit(".py")), F.concat("module", F.lit("/__init__.py")))).alias("reference"),
    )
    present = files.select("bundle_id", F.col("rel_path").alias("reference"))
    return wanted.join(present, ["bundle_id", "reference"], "left_semi").select("bundle_id", "rel_path", "reference")


def with_suffixes(paths: DataFrame, column: str, lengths: DataFrame) -> DataFrame:
    """Trailing parts of a path, as `suffix`, of the lengths that the bundle's other side has: a suffix test as an equi-join."""
    cut = F.explode(F.filter("lengths", lambda n: n <= F.length(column)))
    rows = paths.join(lengths, "bundle_id").select(*paths.columns, cut.alias("_n"))
    return rows.withColumn("suffix", F.expr(f"right({column}, _n)")).drop("_n")


def _lengths(paths: DataFrame, column: str) -> DataFrame:
    """The lengths of a bundle's paths: no more than the longest path has characters."""
    return paths.where(F.length(column) > 0).groupBy("bundle_id").agg(F.collect_set(F.length(column)).alias("lengths"))


def without_partner(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """Rows of `left` whose path is no suffix of a right path and has none as its own suffix.

    Equal paths go first; then both directions are equi-joins on (bundle, path part), with parts only of the lengths
    that still occur on the other side. No pairs within a bundle are formed.
    """
    l = left.withColumn(left_col, slashes(F.col(left_col)))
    r = right.select("bundle_id", slashes(F.col(right_col)).alias("_r")).distinct()
    unequal = l.join(r.withColumnRenamed("_r", left_col), ["bundle_id", left_col], "left_anti")
    asked = unequal.select("bundle_id", left_col).distinct()
    longer = with_suffixes(r, "_r", _lengths(asked, left_col)).select("bundle_id", F.col("suffix").alias(left_col))
    shorter = (
        with_suffixes(asked, left_col, _lengths(r, "_r"))
        .join(r.withColumnRenamed("_r", "suffix"), ["bundle_id", "suffix"], "left_semi").select("bundle_id", left_col)
    )
    return unequal.join(longer.unionByName(shorter).distinct(), ["bundle_id", left_col], "left_anti")

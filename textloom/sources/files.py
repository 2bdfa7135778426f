"""File listings: which files of a folder are text to be indexed."""

from __future__ import annotations

import fnmatch
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the filters of file listings name.
TEXT_EXTENSIONS = """.txt .md .markdown .rst .org .adoc .tex .rtf .text .log .py .pyi .pyw .js .ts .jsx .tsx .mjs .cjs .vue .svelte
.c .h .cpp .hpp .cc .hh .cxx .hxx .go .rs .zig .java .kt .kts .scala .clj .cljs .groovy .gradle .cs .fs .vb .csproj .fsproj
.rb .php .pl .pm .lua .r .R .jl .swift .m .mm .hs .ml .mli .ex .exs .erl .sh .bash .zsh .fish .ps1 .bat .cmd
.html .htm .css .scss .sass .less .xml .xsl .xslt .svg .json .jsonl .ndjson .yaml .yml .toml .ini .cfg .conf .properties .csv .tsv .env.example .env.template
.sql .graphql .gql .prisma .editorconfig .eslintrc .prettierrc .babelrc .npmrc .yarnrc .pdf .docx .xlsx .pptx .eml .diff .patch""".split()
BINARY_EXTENSIONS = """.png .jpg .jpeg .gif .bmp .ico .icns .tiff .tif .webp .avif .heic .heif .psd .ai .eps .raw .cr2 .nef .svg
.mp4 .avi .mov .mkv .wmv .flv .webm .m4v .mpg .mpeg .3gp .mp3 .wav .ogg .flac .aac .wma .m4a .opus .mid .midi
.zip .tar .gz .bz2 .xz .7z .rar .tgz .tar.gz .tar.bz2 .tar.xz .zst .dmg .iso .img .pyc .pyo .class .o .obj .so .dylib .dll .exe .bin .elf .wasm .a .lib .ko
.doc .ppt .xls .odt .ods .odp .pages .numbers .key .ttf .otf .woff .woff2 .eot .db .sqlite .sqlite3 .mdb .accdb .db-wal .db-shm
.deb .rpm .apk .msi .pkg .snap .pkl .pickle .npy .npz .h5 .hdf5 .parquet .avro .arrow .feather .pb .onnx .pt .pth .safetensors .dat
.p12 .pfx .pem .der .cer .crt .blend .fbx .glb .gltf .usd .usda .swf .fla .lock .log .map""".split()
EXCLUDED_DIRS = """.git .svn .hg .bzr .fossil node_modules vendor bower_components .pnpm .yarn jspm_packages web_modules
__pycache__ .venv venv env .env .tox .pytest_cache .mypy_cache .ruff_cache .pytype site-packages .eggs *.egg-info .bundle vendor/bundle target .gradle .mvn .m2
bin obj packages dist build _build out output .output .next .nuxt .svelte-kit .vercel .netlify .parcel-cache .webpack .rollup.cache
.idea .vscode .vs .eclipse .settings .project .classpath .factorypath .DS_Store Thumbs.db .Spotlight-V100 .Trashes ehthumbs.db Desktop.ini $RECYCLE.BIN
.cache .tmp tmp temp .temp .sass-cache .eslintcache .stylelintcache coverage .nyc_output htmlcov .coverage __snapshots__ .jest
.terraform .vagrant .docker .turbo .nx .rush logs log""".split()
EXCLUDED_FILES = """package-lock.json yarn.lock pnpm-lock.yaml Gemfile.lock Pipfile.lock poetry.lock uv.lock composer.lock Cargo.lock go.sum flake.lock
.gitattributes .gitmodules .env .env.local .env.production .env.development .env.staging .env.test .DS_Store Thumbs.db desktop.ini .npmrc .npmignore
pip-log.txt pip-delete-this-directory.txt""".split()
PLAIN_NAMES = """Makefile GNUmakefile makefile Dockerfile Containerfile Vagrantfile Procfile Brewfile Gemfile Rakefile Guardfile LICENSE LICENCE COPYING NOTICE README CHANGELOG CHANGES HISTORY
AUTHORS CONTRIBUTORS INSTALL TODO HACKING .gitignore .gitattributes .gitmodules .dockerignore .editorconfig .eslintignore .prettierignore .npmignore .slugignore .flake8 .pylintrc .rubocop.yml
.clang-format .clang-tidy CMakeLists.txt go.mod go.sum requirements.txt constraints.txt setup.py setup.cfg""".split()
BROWSER_DIRS = "chromium google-chrome chrome brave edge msedge electron".split()
BROWSER_CACHES = ["cache", "cache_data", "code cache", "gpucache", "shadercache", "grshadercache", "graphitedawncache"]
WATCH_IGNORED_EXTENSIONS = ".pyc .pyo .class .o .so .dylib .dll .db .db-shm .db-wal .sqlite .sqlite3 .lock .log .png .jpg .jpeg .gif .bmp .ico .svg .webp .mp3 .mp4 .wav .avi .mkv .mov .zip .tar .gz .bz2 .xz .7z .rar .whl .egg".split()
WATCH_IGNORED_DIRS = "__pycache__ .git .svn .hg node_modules .venv venv .tox .mypy_cache .pytest_cache dist build .eggs .cache".split()


OWN_DIR = ".textloom"  # where this project keeps an index in a folder


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """From the last dot of the name on; none for names without one, or with only a leading one."""
    return F.regexp_extract(name_of(path), r"[^.](\.[^.]*)$", 1)


def dirs_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p != "")


def glob(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(fnmatch.translate(p).replace(r"\z", r"\Z")) for p in patterns), F.lit(False))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a user's patterns name a path (relative to the folder): a glob on the name or the whole path, or
    the bare name of a folder or file."""
    bare = [p for p in patterns if not set(p) & set("/*?")]
    return glob(name_of(path), patterns) | glob(path, patterns) | F.exists(F.split(path, "/"), lambda x: x.isin(bare))


def pruned(path: Column, size: Column, max_size: int, exclude: list[str]) -> Column:
    """Whether a file is out by its path and size alone, whatever it holds."""
    name, ext, dirs = name_of(path), extension_of(path), dirs_of(path)
    eggs = F.exists(dirs, lambda d: d.endswith(".egg-info"))
    hidden = F.arrays_overlap(dirs, F.array(*map(F.lit, [*EXCLUDED_DIRS, OWN_DIR]))) | F.exists(dirs, lambda d: d.startswith(".")) | eggs
    return hidden | F.lower(ext).isin(BINARY_EXTENSIONS) | name.isin(EXCLUDED_FILES) | excluded(path, exclude) | ~size.between(1, max_size)


def listed(path: Column, include: list[str]) -> Column:
    """Whether the extension, or the name of a file without one, is known to be text."""
    ext = F.lower(extension_of(path))
    return ext.isin([*(x.lower() for x in TEXT_EXTENSIONS), *include]) | (ext == "") & name_of(path).isin(PLAIN_NAMES)


def walk_filter(path: Column, size: Column, max_size: int = 2 * 1024 * 1024, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a file is indexed, from its path (relative to the folder) and size alone: no excluded or hidden
    folder above it, no binary extension, no excluded name or user's pattern, a listed extension or name."""
    return ~pruned(path, size, max_size, list(exclude)) & listed(path, list(include))


def ignored(path: Column, exclude: list[str] = (), max_depth: int | None = None, folder: str = "") -> Column:
    """Whether a watcher ignores a changed path below a folder."""
    inside = F.when(path.startswith(folder), F.substring(path, F.lit(len(folder) + 1), F.length(path))).otherwise(path) if folder else path
    parts, ext = F.split(inside, "/"), F.lower(extension_of(path))
    low = F.split(F.lower(path), "/")
    out = ext.isin(WATCH_IGNORED_EXTENSIONS) | F.arrays_overlap(parts, F.array(*map(F.lit, [*WATCH_IGNORED_DIRS, OWN_DIR]))) | F.exists(parts, lambda p: p.rlike(r"^\.[^.]"))
    out = out | F.arrays_overlap(low, F.array(*map(F.lit, BROWSER_DIRS))) & F.arrays_overlap(low, F.array(*map(F.lit, BROWSER_CACHES)))
    if exclude:
        out = out | excluded(inside, list(exclude)) | reduce(lambda a, b: a | b, (F.contains(path, F.lit(p)) for p in exclude if "/" in p and not set(p) & set("*?")), F.lit(False))
    return out if max_depth is None else out | (F.size(dirs_of(inside)) > max_depth)


def gitignored(listing: DataFrame, rules: DataFrame) -> DataFrame:
    """listing (path, ...) without what rules (dir, pattern) of .gitignore files name in their subtree.

    A pattern is a glob on a file's own name, or on a folder's if it ends in a slash; comments, blanks and
    negations are no rules. Rules meet distinct names, not files.
    """
    folders = F.transform(dirs_of(F.col("path")), lambda x: F.concat(x, F.lit("/")))
    parts = F.explode(F.array_distinct(F.concat(F.array(name_of(F.col("path"))), folders))).alias("part")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+^$(){}|\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    rule = rules.filter(~F.col("pattern").rlike(r"^\s*(#|!|$)")).select("dir", regex.alias("regex"))
    names = listing.select("path", parts)
    distinct = names.select("part").distinct().join(rule, F.expr("part rlike regex")).select("part", "dir")
    gone = names.join(distinct, "part").filter(F.col("path").startswith(F.col("dir"))).select("path")
    return listing.join(gone.distinct(), "path", "left_anti")


def _binary_files(spark: SparkSession, folder: str) -> DataFrame:
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", r"^file:/+", "/")
    inside = F.substring(path, F.lit(len(folder.rstrip("/")) + 2), F.length(path))
    return d.select(path.alias("path"), inside.alias("inside"), F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").alias("mtime"), "content")


def gitignore_rules(listing: DataFrame, folder: str) -> DataFrame:
    """(dir, pattern) of the .gitignore files in the folders that listing (inside) names. Spark's readers pass
    over names that begin with a dot, so executors open these files themselves, each folder's once."""
    parts = dirs_of(F.col("inside"))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.transform(F.slice(parts, F.lit(1), i), lambda x: F.concat(x, F.lit("/"))), ""))
    dirs, base = listing.select(F.explode(above).alias("dir")).distinct(), folder.rstrip("/") + "/"
    schema = pa.schema([("dir", pa.string()), ("pattern", pa.string())])

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for d in b.column(0).to_pylist():
                place, path = fs.FileSystem.from_uri(f"{base}{d}.gitignore")
                if place.get_file_info(path).type == fs.FileType.File:
                    with place.open_input_stream(path) as f:
                        lines = [x.strip() for x in f.read().decode(errors="replace").splitlines()]
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(lines), pa.string()), pa.array(lines, pa.string())], schema=schema)

    return dirs.mapInArrow(run, "dir string, pattern string")


def list_files(spark: SparkSession, folder: str, max_size: int = 2 * 1024 * 1024, include: list[str] = (), exclude: list[str] = (), gitignore: bool = True) -> DataFrame:
    """(path, size, mtime) of the files to index. Files without an extension and without a known name are
    looked into (their first 8 KB); no other content is read, but for .gitignore files, whose rules hold in
    their subtree (pass gitignore=False for a store that only Spark can read)."""
    d = _binary_files(spark, folder)
    named = d.drop("content").filter(~pruned(F.col("inside"), F.col("size"), max_size, list(exclude)))
    known = named.filter(listed(F.col("inside"), list(include)))
    unknown = d.filter((extension_of(F.col("inside")) == "") & ~pruned(F.col("inside"), F.col("size"), max_size, list(exclude)) & ~listed(F.col("inside"), list(include)))
    out = known.unionByName(unknown.filter(is_utf8_text(F.col("content"))).drop("content"))
    if gitignore:
        left = gitignored(out.select(F.col("inside").alias("path"), F.col("path").alias("full"), "size", "mtime"), gitignore_rules(out, folder))
        return left.select(F.col("full").alias("path"), "size", "mtime")
    return out.drop("inside")


def read_files(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(path, size, mtime, content) of the files to index."""
    content = _binary_files(spark, folder).select("path", "content")
    return list_files(spark, folder, **options).join(content, "path").select("path", "size", "mtime", "content")


def _head(content: Column) -> Column:
    """The first 8 KB, without a character that the cut may have split."""
    first = F.substring(content, 1, 8192)
    whole = F.regexp_replace(F.decode(first, "ISO-8859-1"), r"[\xC0-\xFF][\x80-\xBF]{0,2}$", "")
    return F.when(F.length(content) > 8192, F.encode(whole, "ISO-8859-1")).otherwise(first).cast("string")


def is_utf8_text(content: Column) -> Column:
    """No NUL and valid UTF-8 in the first 8 KB."""
    head = _head(content)
    return F.is_valid_utf8(head) & ~F.contains(head, F.lit("\u0000")) & (F.length(content) > 0)


def is_text(content: Column) -> Column:
    """No NUL, valid UTF-8 and mostly printable, in the first 8 KB."""
    head = _head(content)
    odd = F.length(F.regexp_replace(head, r"[^\x00-\x08\x0E-\x1F\x7F]", ""))
    return F.is_valid_utf8(head) & (F.instr(head, "\u0000") == 0) & ((F.length(head) - odd) / F.greatest(F.length(head), F.lit(1)) > 0.7)

"""Repository sources: recursive scans, ignore rules, directory listings, line slices, important files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksift.functions import text as T

# Folders never scanned.
SKIPPED = tuple("""node_modules .git .svn .hg target build dist .next .nuxt .output .cache __pycache__ .pycache venv .venv env .env vendor bower_components .bundle .gem .tox coverage
.nyc_output .serverless .terraform .pytest_cache .mypy_cache .dart_tool .pub-cache .gradle Pods .build bin obj out .yarn .pnp .pnp.js .turbo .vercel""".split())
# Files of a root that say how a project is built, run and licensed.
IMPORTANT = tuple(""".gitignore .gitattributes .gitmodules README README.md README.txt README.rst CONTRIBUTING CONTRIBUTING.md CONTRIBUTING.txt CONTRIBUTING.rst LICENSE LICENSE.md LICENSE.txt
CHANGELOG CHANGELOG.md CHANGELOG.txt CHANGELOG.rst SECURITY SECURITY.md SECURITY.txt CODEOWNERS requirements.txt Pipfile Pipfile.lock pyproject.toml setup.py setup.cfg package.json
package-lock.json yarn.lock npm-shrinkwrap.json Gemfile Gemfile.lock composer.json composer.lock pom.xml build.gradle build.gradle.kts build.sbt go.mod go.sum Cargo.toml Cargo.lock mix.exs
rebar.config project.clj Podfile Cartfile dub.json dub.sdl .env .env.example .editorconfig tsconfig.json jsconfig.json .babelrc babel.config.js .eslintrc .eslintignore .prettierrc .stylelintrc
tslint.json .pylintrc .flake8 .rubocop.yml .scalafmt.conf .dockerignore .gitpod.yml sonar-project.properties renovate.json dependabot.yml .pre-commit-config.yaml mypy.ini tox.ini .yamllint
pyrightconfig.json webpack.config.js rollup.config.js parcel.config.js gulpfile.js Gruntfile.js build.xml build.boot project.json build.cake MANIFEST.in Makefile CMakeLists.txt pytest.ini
phpunit.xml karma.conf.js jest.config.js vitest.config.ts vitest.config.js cypress.json .nycrc .nycrc.json .travis.yml .gitlab-ci.yml Jenkinsfile azure-pipelines.yml bitbucket-pipelines.yml
appveyor.yml circle.yml .circleci/config.yml .github/dependabot.yml codecov.yml .coveragerc Dockerfile docker-compose.yml docker-compose.override.yml serverless.yml firebase.json now.json
netlify.toml vercel.json app.yaml terraform.tf main.tf cloudformation.yaml cloudformation.json ansible.cfg kubernetes.yaml k8s.yaml schema.sql liquibase.properties flyway.conf next.config.js
next.config.ts nuxt.config.js vue.config.js angular.json gatsby-config.js gridsome.config.js svelte.config.js swagger.yaml swagger.json openapi.yaml openapi.json .nvmrc .ruby-version
.python-version Vagrantfile .node-version .codeclimate.yml mkdocs.yml _config.yml book.toml readthedocs.yml .readthedocs.yaml .npmrc .yarnrc .isort.cfg .markdownlint.json .markdownlint.yaml
.bandit .secrets.baseline .pypirc .gitkeep .npmignore .nixpacks docker-entrypoint.sh""".split())


@dataclass(frozen=True)
class Rule:
    """An ignore rule: its order, whether it re-admits, whether it is for folders only, its regular expression."""

    ord: int
    negated: bool
    dir_only: bool
    regex: str


def parse_rules(text: str, base: str = "", start: int = 0) -> list[Rule]:
    """The rules of an ignore file in the folder ``base``: ``!`` re-admits, a last slash means folders, a slash elsewhere ties to the folder."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        pattern = line[negated:]
        dir_only = pattern.endswith("/")
        pattern = pattern.rstrip("/")
        tied = "/" in pattern
        body = T.glob_regex(pattern.lstrip("/"))
        folder = T.glob_regex(base.strip("/")) + "/" if base.strip("/") else ""
        tail = "/.*" if dir_only else "(?:/.*)?"
        out.append(Rule(start + len(out), negated, dir_only, f"^{folder}{'' if tied else '(?:.*/)?'}{body}{tail}$"))
    return out


def ignored(files: DataFrame, rules: list[Rule], path: str = "path", output: str = "ignored") -> DataFrame:
    """Files with whether the last rule that matches a path (or a folder of it) ignores it; rules are few and go in as expressions."""
    last: Column = F.lit(False)
    for r in sorted(rules, key=lambda r: r.ord):
        last = F.when(F.col(path).rlike(r.regex), F.lit(not r.negated)).otherwise(last)
    return files.withColumn(output, last)


def scan(spark: SparkSession, root: str, rules: list[Rule] | None = None, max_files: int | None = 10_000) -> DataFrame:
    """(path, body, lang, mtime) of the supported files below a root, by path, without skipped and dot folders and ignored paths."""
    either = lambda suffix: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)
    names = "*{" + ",".join(map(either, T.LANGUAGES)) + "}"  # other files are not read
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    full = F.regexp_replace("path", "^[a-z]+:/{1,3}", "/")
    rows = raw.select(F.substring_index(full, base, -1).alias("path"), "modificationTime", "content")
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = rows.withColumn("lang", T.language(F.col("path"))).where("lang is not null").where(~F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED)))
    rows = ignored(rows, rules or []).where(~F.col("ignored"))
    out = rows.select("path", F.decode("content", "UTF-8").alias("body"), "lang", F.col("modificationTime").alias("mtime"))
    return out.orderBy("path").limit(max_files) if max_files else out


def listing(files: DataFrame, folder: str, cap: int = 20) -> DataFrame:
    """(path, count_before_cap, capped): the files directly in a folder, by path."""
    inside = files.where(T.directory(F.col("path")) == folder.strip("/"))
    n = inside.agg(F.count("*").alias("count_before_cap"))
    return inside.select("path").orderBy("path").limit(cap).crossJoin(F.broadcast(n)).withColumn("capped", F.col("count_before_cap") > cap)


def naming(files: DataFrame, identifiers: list[str], cap: int = 500) -> DataFrame:
    """Files whose path holds one of the identifiers, in any case."""
    test = F.lit(False)
    for i in identifiers:
        test = test | F.lower("path").contains(i.lower())
    return files.where(test).orderBy("path").limit(cap)


def line_slice(body: Column, offset: int = 1, limit: int | None = None) -> Column:
    """Some lines of a text, from line ``offset``."""
    lines = F.split(body, "\n", -1)
    return F.array_join(F.slice(lines, offset, limit if limit is not None else F.greatest(F.size(lines), F.lit(1))), "\n")


def read_many(paths: DataFrame, files: DataFrame, offset: int = 1, limit: int | None = None) -> DataFrame:
    """A row for each asked (index, path): text, ok, error; unsafe and missing paths are errors of their own."""
    got = paths.join(files.select("path", "body"), "path", "left")
    unsafe = T.unsafe_path(F.col("path"))
    error = F.when(unsafe, "unsafe path").when(F.col("body").isNull(), "not found")
    return got.select("index", "path", F.when(error.isNull(), line_slice(F.col("body"), offset, limit)).alias("text"), error.isNull().alias("ok"), error.alias("error"))


def important(path: Column) -> Column:
    """A known file of the root, or a workflow."""
    return path.isin(*IMPORTANT) | path.rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$")


def aliases(spark: SparkSession, config: str) -> DataFrame:
    """(prefix, target) of a project file's path aliases: keys ``prefix/*``, first targets ``./dir/*``."""
    row = spark.createDataFrame([(config,)], "j string").select(F.from_json("j", "compilerOptions struct<paths:map<string,array<string>>>").alias("c"))
    pairs = row.select(F.explode("c.compilerOptions.paths").alias("key", "targets")).select("key", F.get("targets", F.lit(0)).alias("target"))
    return pairs.where("key like '%/*' and target like './%/*'").select(F.regexp_replace("key", r"/\*$", "").alias("prefix"), F.regexp_extract("target", r"^\./(.*)/\*$", 1).alias("target"))

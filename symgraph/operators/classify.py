"""Classifiers over names, kinds, paths, decorators and imports. Column expressions only: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.functions import vocabulary as v
from symgraph.functions.scalars import extension

# Fixed values ---------------------------------------------------------------------------------------------------------
ROUTE_METHODS = ["get", "post", "put", "delete", "patch", "head", "options", "websocket", "route", "api_route", "websocket_route"]
ENTRY_CALLABLE_KINDS = ["function", "method", "route", "endpoint", "lambda", "jsx_element", "component"]
CATEGORY_RULES = [("Tests", ["test", "spec"]), ("CLI", ["cli", "bin"]), ("Workers", ["worker", "job"]), ("Cron", ["cron"]), ("Scripts", ["scripts/"]), ("Next.js Pages", ["/pages/", "/app/"])]
LAYER_RULES = [("Persistence", ["db", "database", "model", "schema"]), ("Infrastructure", ["util", "config", "core"]), ("Presentation", ["api", "route", "controller", "view", "page", "component"]), ("Business", ["service", "manager", "logic", "auth"])]


def _any_part(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def route_decorator(attribute: Column) -> Column:
    """True if the called name, or its last dotted part, registers a route."""
    head = F.trim(F.substring_index(F.regexp_replace(F.trim(attribute), "^@+", ""), "(", 1))
    return F.lower(F.substring_index(head, ".", -1)).isin(ROUTE_METHODS)


def entrypoint_class(name: Column, kind: Column, path: Column, attributes: Column) -> Column:
    """Route, Page, Cli or null. An explicit kind wins over decorators, these over the file's place, this over Python's main."""
    kind, slashed = F.lower(kind), F.replace(path, F.lit("\\"), F.lit("/"))
    low, ext = F.lower(slashed), F.lower(extension(slashed))
    stem = F.regexp_replace(F.substring_index(low, "/", -1), r"(?<=.)\.[^.]*$", "")
    callable_ = kind.isin(ENTRY_CALLABLE_KINDS)
    component = callable_ & F.coalesce(F.upper(F.substring(name, 1, 1)) != F.lower(F.substring(name, 1, 1)), F.lit(False)) & (F.substring(name, 1, 1) == F.upper(F.substring(name, 1, 1)))
    web = ext.isin("tsx", "jsx", "ts", "js")
    app, pages = low.contains("/app/") | low.startswith("app/"), low.contains("/pages/") | low.startswith("pages/")
    handler_file = web & app & (stem == "route") & ext.isin("ts", "js")
    page_file = web & app & stem.isin("page", "layout", "template", "default")
    in_pages = web & pages & ext.isin("tsx", "jsx")
    by_place = (
        F.when(handler_file, F.when(callable_, "Route"))
        .when(page_file, F.when(component, "Page"))
        .when(in_pages, F.when(component & ~stem.isin("_app", "_document"), F.when(low.contains("/pages/api/"), "Route").otherwise("Page")))
    )
    python = F.when(path.endswith("__main__.py") & (callable_ | (kind == "class")), "Cli").when((kind == "function") & (name == "main") & path.endswith(".py"), "Cli")
    decorated = callable_ & F.coalesce(F.exists(attributes, route_decorator), F.lit(False))
    return F.when(kind.isin("page", "layout"), "Page").when(kind.isin("route", "endpoint"), "Route").when(decorated, "Route").otherwise(F.coalesce(by_place, python))


def entrypoints(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols that are entrypoints, with their class. Symbols without a column of decorators have none."""
    attributes = F.col("attributes") if "attributes" in symbols.columns else F.lit(None).cast("array<string>")
    rows = symbols.join(files.select("file_id", "path"), "file_id")
    return rows.withColumn("class", entrypoint_class(F.col("name"), F.col("kind"), F.col("path"), attributes)).where("class is not null")


def feature_flags(symbols: DataFrame) -> DataFrame:
    """symbol_id and what kind and name tell of it."""
    kind, name = F.lower("kind"), F.col("name")
    public = ~name.startswith("_")
    return symbols.select(
        "symbol_id",
        kind.isin(v.CALLABLE_KINDS).alias("is_callable"),
        kind.isin(v.TYPE_KINDS).alias("is_type"),
        kind.isin(v.LOCAL_KINDS).alias("is_local"),
        kind.isin(v.CONSTANT_KINDS).alias("is_constant"),
        public.alias("is_exported"),
        public.alias("is_public"),
        name.contains("generated").alias("is_generated"),
    )


def entrypoint_category(name: Column, path: Column) -> Column:
    """One of eight buckets; the first rule that holds."""
    path, name = F.lower(path), F.lower(name)
    out = F.when(path.contains("/api/") | path.contains("routes") | name.contains("route") | name.contains("handler"), "HTTP/API")
    for bucket, parts in CATEGORY_RULES:
        out = out.when(_any_part(path, parts) | ((name == "main") if bucket == "CLI" else F.lit(False)), bucket)
    return out.otherwise("Library Exports")


def layer(name: Column, dependencies: Column, dependents: Column) -> Column:
    """Architecture layer of a subsystem: by its name, else by which way its edges go."""
    name, out = F.lower(name), None
    for bucket, parts in LAYER_RULES:
        test = _any_part(name, parts)
        out = F.when(test, bucket) if out is None else out.when(test, bucket)
    return out.when((dependents == 0) & (dependencies > 0), "Presentation").when((dependencies == 0) & (dependents > 0), "Infrastructure").otherwise("Business")


def layers(directory_edges: DataFrame) -> DataFrame:
    """(directory, dependencies, dependents, layer) from edges (from_dir, to_dir); edges inside a directory don't count."""
    across = directory_edges.where("from_dir <> to_dir").select("from_dir", "to_dir").distinct()
    ends = across.select(F.col("from_dir").alias("directory"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(across.select(F.col("to_dir").alias("directory"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    rows = ends.groupBy("directory").agg(F.sum("o").alias("dependencies"), F.sum("i").alias("dependents"))
    return rows.withColumn("layer", layer(F.substring_index("directory", "/", -1), F.col("dependencies"), F.col("dependents")))


def import_state(source: Column, name: Column, language: Column, local_packages: list[str] = ()) -> Column:
    """StandardLibrary, RepositorySymbol, Builtin or ExternalDependency. local_packages: the repository's own Python packages (path parts)."""
    source = F.coalesce(source, F.lit(""))
    rust = lambda heads: F.substring_index(source, "::", 1).isin(heads)
    js, python = language.isin("js", "jsx", "ts", "tsx", "vue", "svelte"), language == "py"
    bare = (source != "") & ~(source.startswith("./") | source.startswith("../") | source.startswith("/") | source.startswith("@/") | source.startswith("~/"))
    base = F.substring_index(source, "/", 1)
    node = base.isin(v.NODE_BUILTINS) | F.regexp_replace(base, "^@+", "").isin(v.NODE_BUILTINS) | source.startswith("node:")
    root = F.substring_index(F.when(source != "", source).otherwise(name), ".", 1)
    own = root.isin(list(local_packages)) if local_packages else F.lit(False)
    in_python = F.when(source.startswith("."), "RepositorySymbol").when(root.isin(v.PYTHON_STDLIB), "StandardLibrary").when(own, "RepositorySymbol").otherwise("ExternalDependency")
    return (
        F.when(rust(["std", "core", "alloc"]), "StandardLibrary")
        .when(rust(["crate", "super", "self"]), "RepositorySymbol")
        .when((language == "rs") & (source != ""), "ExternalDependency")
        .when(js & bare, F.when(node, "Builtin").otherwise("ExternalDependency"))
        .when(python, in_python)
        .otherwise("RepositorySymbol")
    )


def decorators(signature: Column) -> Column:
    """Parts of a signature that begin with @."""
    return F.filter(F.split(signature, r"\s+"), lambda x: x.startswith("@"))

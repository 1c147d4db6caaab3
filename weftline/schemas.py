"""Declared schemas, open vocabularies and the checks against them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """Fields of `name type [not null]`, without a session; nested types by name."""
    fields = [f.split() for f in text.split(", ")]
    return T.StructType([T.StructField(f[0], nested.get(f[1]) or TYPES[f[1]], f[2:] != ["not", "null"]) for f in fields])


PARAMETER = _struct("name string, type string, nullable boolean, optional boolean")
SIGNATURE = _struct("returnType result, parameters list, accessModifier string, isAsync boolean, isGenerator boolean", result=_struct("text string, nullable boolean"), list=T.ArrayType(PARAMETER))
NODES = _struct("id string not null, label string not null, file_type string not null, kind string, source_file string not null, source_location string, community int, signature signature, repo string", signature=SIGNATURE)
EDGES = _struct("source string not null, target string not null, relation string not null, confidence string not null, context string not null, source_file string not null, source_location string, weight double not null, repo string")
RAW_CALLS = _struct("callee string not null, source_file string not null, source_location string, from_id string not null, is_member boolean, receiver_type string")
IMPORTS = _struct("local_name string not null, module string not null, source_file string not null, origin string")
OBSERVATIONS = _struct("id string not null, project_key string not null, scope string not null, type string not null, title string not null, content string not null, topic_key string, session_id string, created_at long not null, updated_at long not null, revision int not null, superseded_by string")
ANCHORS = _struct("observation_id string not null, node_id string not null, role string not null, anchor_label string, anchor_file string, anchor_hash string, created_at long not null")
SESSIONS = _struct("id string not null, project_key string not null, scope string not null, title string, summary string, started_at long not null, ended_at long")
EVENTS = _struct("schemaVersion int, id string, type string, ts long, payload string")

# The vocabularies of the data model, which stay open, unknown values being reported and kept.
CODE_KINDS = ("class", "function", "method", "interface", "module", "concept")
INFRA_KINDS = ("service", "api", "database", "queue", "config", "secret", "finding", "deployment", "environment")
CODE_RELATIONS = ("calls", "imports", "imports_from", "inherits", "implements", "extends", "references", "contains", "method", "uses")
INFRA_RELATIONS = ("deploys", "reads", "writes", "configures", "exposes", "consumes", "produces")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS", "SYNTACTIC")
FILE_TYPES = ("code", "document", "concept", "rationale", "config")


def unknown_values(df: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """Distinct values outside the vocabulary; an advisory, no row is ever dropped for it."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*known)).select(F.col(column).alias("value")).distinct()


def missing_fields(df: DataFrame, schema: T.StructType) -> list[str]:
    """Declared columns that df lacks or holds in another type."""
    have = {f.name: f.dataType for f in df.schema}
    return [f.name for f in schema if have.get(f.name) != f.dataType]

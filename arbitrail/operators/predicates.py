"""Guard for rules written as a Spark SQL condition over a declared event schema.

A condition is accepted only when every node of its analysed tree is on the list below. That is an
allow-list on purpose: ``reflect`` and ``java_method`` run inside an ordinary SQL expression, and an
ANSI cast or an overflow would end the whole job because of one bad event.
"""

from __future__ import annotations

import re
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, IllegalArgumentException, ParseException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ACCEPTED, REFUSED, UNPARSEABLE, NOT_BOOLEAN = "accepted", "refused", "unparseable", "not_boolean"

# The expression nodes a condition may contain.
ALLOWED_NODES = frozenset(
    """
    Alias AttributeReference GetStructField GetArrayStructFields Literal
    And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual
    In InSet Between IsNull IsNotNull Coalesce If CaseWhen NullIf
    StartsWith EndsWith Contains Lower Upper StringTrim Length
    ArrayExists ArrayFilter ArrayTransform ArrayContains Size LambdaFunction NamedLambdaVariable
    Greatest Least
    """.split()
)
# Arithmetic is safe on doubles only: whole numbers can overflow and division by zero raises.
DOUBLE_ONLY_NODES = frozenset("Add Subtract Multiply UnaryMinus Abs".split())


def _nodes(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _allowed(node) -> bool:
    name = node.getClass().getSimpleName()
    if name in ALLOWED_NODES:
        return True
    if name in DOUBLE_ONLY_NODES:
        return node.dataType().typeName() == "double"
    if name in ("RLike", "Like"):
        return _safe_pattern(node, name)
    if name == "Cast":  # only widening numeric casts, which cannot fail
        source, target = node.child().dataType().typeName(), node.dataType().typeName()
        order = ["byte", "short", "integer", "long", "float", "double"]
        exact = source.startswith("decimal") and target == "double"
        return exact or (source in order and target in order and order.index(source) <= order.index(target))
    return False


def _safe_pattern(node, name: str) -> bool:
    """Whether the pattern is a constant that compiles: one from the data could end the job at any row."""
    pattern = node.right()
    if pattern.getClass().getSimpleName() != "Literal" or pattern.value() is None:
        return False
    text = pattern.value().toString()
    if name == "Like":  # the escape character stands before a wildcard or itself
        escape = str(node.escapeChar())
        return re.fullmatch(rf"(?:[^{re.escape(escape)}]|{re.escape(escape)}[_%{re.escape(escape)}])*", text, re.DOTALL) is not None
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(text)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


@lru_cache(maxsize=100_000)
def check_condition(spark: SparkSession, condition: str, event_schema: str) -> str:
    """``accepted``, or why the condition cannot be used. Nothing is executed; a text is judged once in a session."""
    empty = spark.createDataFrame([], event_schema)
    try:
        analysed = empty.select(F.expr(condition).alias("holds"))
    except ParseException:
        return UNPARSEABLE
    except AnalysisException:
        return REFUSED
    project = analysed._jdf.queryExecution().analyzed()
    if project.getClass().getSimpleName() != "Project" or project.child().children().size() > 0:
        return REFUSED
    expression = project.projectList().apply(0)
    if not all(_allowed(n) for n in _nodes(expression)):
        return REFUSED
    if analysed.schema["holds"].dataType.typeName() not in ("boolean", "void"):
        return NOT_BOOLEAN
    return ACCEPTED


"""What an analysed query reads: views, columns and functions.

Only the plan that Spark already made is inspected; no SQL text is parsed here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Leaves that hold no stored data: literals, inline rows and references inside the query.
HARMLESS_LEAVES = frozenset(
    {"OneRowRelation", "OneRowRelation$", "LocalRelation", "CTERelationRef", "UnionLoopRef"}
)
# Spark's own expressions live here; those of Hive, of plug-ins or of the caller do not.
OWN_PACKAGES = ("org.apache.spark.sql.catalyst.",)
# Of Spark's own, the expressions that leave the query language.
REFUSED_EXPRESSIONS = frozenset(
    {
        "CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDAF", "ScalaUDF",
        "ScalaUDAF", "ScalaAggregator", "PythonUDTF", "UnresolvedPolymorphicPythonUDTF",
        "PythonFuncExpression", "UserDefinedGenerator", "ApplyFunctionExpression", "V2Aggregator", "ExternalUserDefinedFunction",
    }
)
# Expressions that hold a query of their own.
NESTED_QUERIES = frozenset({"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"})


@dataclass
class PlanFacts:
    """Datasets by name, their columns that the query reads, and anything refused."""

    datasets: set[str] = field(default_factory=set)
    columns: dict[str, set[str]] = field(default_factory=dict)
    foreign: list[str] = field(default_factory=list)
    refused: list[str] = field(default_factory=list)
    # Every record gives one row that depends on this record alone.
    record_wise: bool = True


def _each(sequence):
    for position in range(sequence.size()):
        yield sequence.apply(position)


def _expressions(expression):
    yield expression
    for child in _each(expression.children()):
        yield from _expressions(child)


def _attributes(references):
    return {attribute.exprId().id() for attribute in _each(references.toSeq())}


# Nodes that neither combine nor drop records.
RECORD_WISE = frozenset({"Project", "SubqueryAlias", "WithCTE", "CTERelationDef", "CTERelationRef", "View"})


def read_plan(frame: DataFrame) -> PlanFacts:
    """Facts of the analysed (not optimised) plan, subqueries included.

    A view is named by its full identifier, so a global or stored view never passes for a local one. Named subqueries are
    followed only where the query refers to them, column by column.
    """
    facts = PlanFacts()
    used: set[int] = set()
    views: list[tuple[str, object]] = []
    definitions: dict[int, object] = {}
    followed: set[int] = set()
    handed: list[tuple[object, object]] = []

    def visit(node):
        kind = node.getClass().getSimpleName()
        if kind not in RECORD_WISE:
            facts.record_wise = False
        if kind == "View":
            identifier = node.desc().identifier()
            if node.isTempView() and identifier.database().isEmpty():
                views.append((identifier.table(), node))
            else:
                facts.foreign.append(f"view {identifier.unquotedString()}")
            return
        if kind == "WithCTE":
            for definition in _each(node.cteDefs()):
                definitions[definition.id()] = definition
            visit(node.plan())
            return
        if kind == "CTERelationRef" and node.cteId() in definitions:
            definition = definitions[node.cteId()]
            handed.append((node, definition))
            if node.cteId() not in followed:
                followed.add(node.cteId())
                visit(definition.child())
            return
        children = list(_each(node.children()))
        if not children and kind not in HARMLESS_LEAVES:
            facts.foreign.append(f"{kind}: {node.simpleString(80)}")
            return
        used.update(_attributes(node.references()))
        for expression in _each(node.expressions()):
            if not expression.deterministic():
                facts.record_wise = False
            for part in _expressions(expression):
                name = part.getClass().getSimpleName()
                if name in REFUSED_EXPRESSIONS or not part.getClass().getName().startswith(OWN_PACKAGES):
                    facts.refused.append(part.toString()[:80])
                if name in NESTED_QUERIES:
                    facts.record_wise = False
                    for outer in _each(part.outerAttrs()):
                        used.update(_attributes(outer.references()))
                    visit(part.plan())
        for child in children:
            visit(child)

    analysed = frame._jdf.queryExecution().analyzed()
    visit(analysed)
    used.update(a.exprId().id() for a in _each(analysed.output()))
    # A column of a named subquery is used where a reference to it is; references may nest.
    grown = True
    while grown:
        before = len(used)
        for reference, definition in handed:
            for outer, inner in zip(_each(reference.output()), _each(definition.child().output())):
                if outer.exprId().id() in used:
                    used.add(inner.exprId().id())
        grown = len(used) > before
    for name, node in views:
        facts.datasets.add(name)
        read = {a.name() for a in _each(node.output()) if a.exprId().id() in used}
        facts.columns.setdefault(name, set()).update(read)
    return facts

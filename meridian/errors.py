"""What can be wrong with a model, an expression or a request."""


class MeridianError(Exception):
    """Base of all errors of this package."""


class ModelError(MeridianError):
    """A model that can't be used."""


class InvalidIDError(ModelError):
    pass


class MissingTableError(ModelError):
    pass


class MissingRelatedKeyError(ModelError):
    pass


class MissingPrimaryKeyError(ModelError):
    pass


class DuplicateCalculationError(ModelError):
    pass


class MissingCalculationError(ModelError):
    pass


class MissingMetricTableError(ModelError):
    pass


class ExpressionSyntaxError(ModelError):
    pass


class UnknownFunctionError(ModelError):
    pass


class InvalidReferenceError(ModelError):
    pass


class MissingMeasureError(MissingCalculationError):
    pass


class MissingDimensionError(MissingCalculationError):
    pass


class CircularReferenceError(ModelError):
    pass


class FilteredMeasureReferenceError(ModelError):
    pass


class ExpressionKindError(ModelError):
    """Aggregates and row values in places that don't take them."""


class MixedAggregationError(ExpressionKindError):
    pass


class NestedAggregateError(ExpressionKindError):
    pass


class AggregateDimensionError(ExpressionKindError):
    pass


class NonAggregateMeasureError(ExpressionKindError):
    pass


class QueryError(MeridianError):
    """A request that the model can't answer."""


class QuerySyntaxError(QueryError):
    pass


class MissingQueryMetricError(QueryError):
    pass


class MissingQueryDimensionError(QueryError):
    pass


class MissingTransformError(QueryError):
    pass


class TransformDimensionError(QueryError):
    """A dimension of `of` or `within` that the request isn't grouped by."""


class TransformTypeError(QueryError):
    pass


class TransformChainError(QueryError):
    """More than one table transform on a metric."""


class DuplicateColumnError(QueryError):
    pass


class ProjectError(MeridianError):
    pass


class ShorthandSyntaxError(MeridianError):
    pass

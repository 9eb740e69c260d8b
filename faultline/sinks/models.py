"""Writer and reader of fitted models."""

from pyspark.ml import PipelineModel


def sink_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

"""Explicit table schemas. Nothing is inferred on read."""

from pyspark.sql import types as T

_L, _I, _D, _S, _B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


IMAGES = _table(image_id=_L, file_name=_S, width=_I, height=_I, split=_S)
CATEGORIES = _table(category_id=_L, name=_S, supercategory=_S, keypoints=T.ArrayType(_S))
ANNOTATIONS = _table(
    ann_id=_L, image_id=_L, category_id=_L, x=_D, y=_D, w=_D, h=_D, area=_D, iscrowd=_B,
    segmentation=T.ArrayType(T.ArrayType(_D)), keypoints=T.ArrayType(_D), num_keypoints=_I,
)
GROUND_TRUTH = _table(image_id=_L, gt_idx=_L, label=_L, x1=_D, y1=_D, x2=_D, y2=_D, area=_D, iscrowd=_B)
DETECTIONS = _table(image_id=_L, det_idx=_L, label=_L, score=_D, x1=_D, y1=_D, x2=_D, y2=_D)
RAW_QUERIES = _table(image_id=_L, query_idx=_I, logits=T.ArrayType(_D), cx=_D, cy=_D, w=_D, h=_D)
MASK_RUNS = _table(image_id=_L, instance_id=_L, label=_L, run_start=_L, run_end=_L)
SHARD_INDEX = _table(
    version=_I, split=_S, policy=_S, shard_id=_L, samples=_L, bytes=_L, generation=_S, digest=_S,
)
RUN_METRICS = _table(run=_S, epoch=_I, step=_I, split=_S, metric=_S, value=_D)
TIMINGS = _table(format=_S, config=_S, batch=_I, call_idx=_I, ms=_D)
DAILY_COUNTS = _table(day=T.DateType(), category=_S, downloads=_L)
WEEKLY_METRICS = _table(
    week_start=T.DateType(), week_end=T.DateType(), stars_total=_L, new_stars=_L, downloads=_L,
)

# One annotation file as published: the whole document is one JSON object.
_BBOX = T.ArrayType(_D)
COCO_DOCUMENT = T.StructType(
    [
        T.StructField("images", T.ArrayType(_table(id=_L, file_name=_S, width=_I, height=_I))),
        T.StructField("categories", T.ArrayType(_table(id=_L, name=_S, supercategory=_S, keypoints=T.ArrayType(_S)))),
        T.StructField(
            "annotations",
            T.ArrayType(
                _table(
                    id=_L, image_id=_L, category_id=_L, bbox=_BBOX, area=_D, iscrowd=_I, segmentation=_S,
                    keypoints=_BBOX, num_keypoints=_I,
                )
            ),
        ),
    ]
)

"""Curation steps: DataFrame in, DataFrame out."""
from millrace.operators.curate import (
    annotate, classify_counts, count_by, dedup_exact, exclude_contained, exclude_overlap, identify, integrate,
    profile, verify_membership,
)
from millrace.operators.evaluate import ranking_metrics, split_folds
from millrace.operators.infer import fit_linear, linear_model, load_model, predict, save_model
from millrace.operators.joins import as_of, in_interval, interval_summary
from millrace.operators.similar import exclude_similar, representatives, similar_groups
from millrace.operators.structure import candidate_keys, inclusions

__all__ = [
    "annotate", "as_of", "candidate_keys", "classify_counts", "count_by", "dedup_exact", "exclude_contained", "exclude_overlap", "exclude_similar", "fit_linear", "identify",
    "in_interval", "interval_summary", "inclusions", "integrate", "linear_model", "load_model", "predict", "profile", "ranking_metrics", "representatives", "save_model", "similar_groups", "split_folds", "verify_membership",
]

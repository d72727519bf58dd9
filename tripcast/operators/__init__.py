"""Table operators: features, candidates, predictors, model, evaluation."""

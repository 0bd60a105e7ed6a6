"""Bar, feature, label, model, execution and report operators."""

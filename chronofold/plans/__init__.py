"""Views, reports and queries composed of the operators."""

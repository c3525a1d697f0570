"""DataFrame operators. Column names are parameters; nothing here runs an action
except the label loop in ``resolve``."""

"""Expected-loss analytics on loan panels, written as Spark DataFrame operators."""

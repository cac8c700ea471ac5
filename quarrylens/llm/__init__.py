"""Training-data operators: each module holds one operator, its thin query and, where SQL can say it, its SQL."""

"""DataFrame operators: rollup, numbering, navigation, tiers and cost."""

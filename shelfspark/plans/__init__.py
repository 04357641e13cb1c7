"""Plans that later operators share: views, features, scores, money impact."""

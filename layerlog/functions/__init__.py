"""layerlog.functions"""
